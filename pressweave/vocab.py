"""Fixed vocabularies and default thresholds shared by every job."""

# ---- fixed values: must equal the published data model ----------------------

TOPICS = [
    "politika",
    "világ",
    "gazdaság",
    "társadalom",
    "bűnügyek",
    "sport",
    "kultúra",
    "tudomány",
    "technológia",
    "egészség",
    "időjárás",
    "szórakozás",
    "vélemény",
]

TOPIC_WEIGHTS = {
    "politika": 1.0,
    "világ": 1.0,
    "gazdaság": 0.85,
    "társadalom": 0.85,
    "bűnügyek": 0.85,
    "sport": 0.65,
    "tudomány": 0.65,
    "technológia": 0.65,
    "vélemény": 0.65,
    "kultúra": 0.4,
    "időjárás": 0.4,
    "szórakozás": 0.4,
    "egészség": 0.4,
}
DEFAULT_TOPIC_WEIGHT = 0.5

BIAS_ZONES = ["left", "center-left", "center", "center-right", "right"]
ARTICLE_TYPES = ["event", "aggregation", "opinion", "background"]
EXCLUDED_IMAGE_SOURCES = ["24hu", "hang"]
BROKEN_TEXT = ["n/a", "null", "undefined"]
USAGE_MODES = ["gemini-fallback", "openrouter"]
DEFAULT_USAGE_MODE = "openrouter"

# assignment of single articles to stories
SIM_THRESHOLD = 0.72
CANDIDATE_MARGIN = 0.05
MAX_STORY_SIZE = 12
MIN_COHERENCE = 0.60
WEIGHT_SEMANTIC = 0.65
WEIGHT_ENTITY = 0.25
WEIGHT_TOKEN = 0.10
ASSIGN_LOOKBACK_HOURS = 24

# re-clustering
MAX_CLUSTER_SIZE = 24
TIME_WEIGHT = 0.55
TIME_SCALE_HOURS = 12.0
MIN_SAMPLES = 3
SPLIT_EPSILON = 0.10
MERGE_THRESHOLD = 0.97
MERGE_MAX_SIZE = 24
OUTLIER_CENTROID_SIM = 0.80
OUTLIER_NEIGHBOUR_SIM = 0.82

# repair window
REPAIR_LOOKBACK_HOURS = 24
REPAIR_GRACE_MINUTES = 90
REPAIR_MAX_ARTICLES = 100
REPAIR_MAX_STORIES = 50

# monthly quotas used by the cost projection
QUOTA_REQUESTS = 2_000_000
QUOTA_VCPU_SECONDS = 180_000
QUOTA_GIB_SECONDS = 360_000

# ---- fixed values: low-value content rules (id, word pattern, weight) --------

LOW_VALUE_SOURCE_BOOSTS = ["ripost", "origo", "metropol", "blikk"]

LOW_VALUE_TITLE = [
    ("sexualized", "dogos|szexi|szexizik|bikini|meztelen|falatnyi", 3),
    ("celebrity", "celeb|sztar|tv-sztar|enekesno|modell|influenszer|vip", 2),
    ("gallery", "fotok|videok|galeria|kepgaleria|kepek|foto|video", 2),
    ("curiosity",
     "lelegzetelallito|nem hiszed el|ezt latnod kell|mutatjuk|nezze meg|brutalis atalakulas", 1),
    ("quiz", "kviz|teszt|tudasproba|optikai illuzio", 2),
    ("horoscope", "horoszkop|csillagjegy", 2),
    ("travel", "utazas|utazo|destinations?", 1),
    ("howto", "recept|tippek|dugulas|vizvezetek-szerelo", 1),
]

LOW_VALUE_URL = [
    ("url-gallery", "foto|fotok|video|videok|galeria|kepgaleria", 2),
    ("url-entertainment", "sztar|sztardzsusz|celeb|vip|bulvar|eletmod|szorakozas", 2),
    ("url-lifestyle", "mindekozben|ezo|huha|tippek|utazas|szorakozas|sztarvilag", 2),
]

LOW_VALUE_CATEGORY = [
    ("category-entertainment",
     "hazai sztarok|nemzetkozi sztarok|sztarvilag|mindekozben|ezo|huha|tippek|vip|sztar|sztardzsusz"
     "|celeb|bulvar|eletmod|szorakozas|showbiz|utazas|kviz|horoszkop|csillagjegy", 2),
]

STRICT_LOW_VALUE = [
    ("quiz-content",
     "kviz|kvizjatek|tudasproba|teszteld|tesztelje tudasat|mennyit tudsz|jol szelektalsz"),
    ("weather-filler",
     "strandoido|fokozodik a hoseg|milyen idojaras var|megerkezik.*meleg|berobban a nyar"),
    ("soft-curiosity",
     "albino bivaly|bogarra vadaszo rokakolyok|samu.*elefant|ave mariat|johnny depp|kozso|bochkor"),
    ("sexualized-sport-celebrity", "jakabos.*bikini|szettart labakkal|aprocska bikiniben"),
]

PUBLIC_INTEREST = [
    ("politics",
     "kormany|miniszter|kepviselo|parlament|orszaggyules|fidesz|tisza|dk|momentum|part|ellenzek"
     "|polgarmester|valasztas|onkormanyzat"),
    ("institutions",
     "rendorseg|ugyeszseg|birosag|nav|mnb|allam|hatosag|korhaz|iskola|egyetem"),
    ("crime-courts",
     "nyomozas|vad|per|itelet|korrupcio|csalas|gyilkossag|letartoztatas|rendorsegi akcio"),
    ("economy",
     "gazdasag|ado|inflacio|forint|energia|munkaber|ceg|vallalat|beruhazas|koltsegvetes"),
    ("foreign-war",
     "haboru|ukrajna|oroszorszag|izrael|nato|eu|szankcio|diplomacia|migracio"),
    ("public-services",
     "egeszsegugy|oktatas|kozlekedes|vasut|mav|bkk|infrastruktura|jarat"),
    ("emergency", "baleset|katasztrofa|tuz|arviz|riasztas|mentok|idojaras"),
    ("public-category", "belfold|kulfold|gazdasag|politika|kozelet|aktualis|itthon"),
]

THIN_MEDIA_WORDS = "foto|video|galeria|kepek"
STRICT_REASON = "Low-value quiz, weather filler, celebrity, or curiosity item"
MEDIA_REASON = ("Low-value celebrity, gallery, video, or entertainment item "
                "without public-interest signals")

# ---- fixed values: event-role stems ------------------------------------------

REACTION_STEMS = [
    "reag[aá]l",
    "b[ií]r[aá]l",
    "megsz[oó]lalt",
    "visszasz[oó]lt",
    "komment[aá]lja",
    "t[aá]mogat[aá]s[aá]r[oó]l biztos",
    "figyelmeztet[eé]s",
]

ANNOUNCEMENT_STEMS = [
    "bejelent",
    "beny[uú]jt",
    "vissza[aá]ll",
    "kinevez",
    "el[oő]l[eé]ptet",
    "v[aá]dat emel",
    "panaszt (tesz|ny[uú]jt)",
    "megnyit",
]

# ---- fixed values: embedding-text boilerplate ---------------------------------

TITLE_PREFIXES = ("Élő|ÉLŐ|Videó|VIDEÓ|Friss|FRISS|Percről percre|Exkluzív|EXKLUZÍV")

BOILERPLATE = [
    r"(?s)Borítókép:.*$",
    r"További játékainkhoz kattintson ide!$",
    r"Cikkünket? frissítjük\.?",
    r"Már előfizetőnk vagy\? Jelentkezz be!$",
    r"(?s)ElőfizetekMár csatlakoztál hozzánk\?.*$",
    r"(?s)Megnézem a csomagokat Már előfizetőnk vagy\?.*$",
    r"lájkolja a HVG Tech rovatának Facebook-oldalát\.$",
]
