"""Does a cluster hang together? Embedding outliers, metadata suspicion, guarded splits, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import non_empty, norm_entities, significant_tokens, strip
from ..operators.groups import centroid, contained_forms
from ..operators.simjoin import cosine, knn_join
from ..session import cut, cut_large
from .pairing import SOFT_ROLES

IDENTITY = ("story_identity", "main_event", "title")


def identity_text():
    return F.concat_ws(" ", *[non_empty(c) for c in IDENTITY])


def embedding_outliers(members: DataFrame, centroid_sim: float = vocab.OUTLIER_CENTROID_SIM,
                       neighbour_sim: float = vocab.OUTLIER_NEIGHBOUR_SIM) -> DataFrame:
    """Members ``(cluster, id, embedding)`` of clusters of three or more that lie far from the mean or from
    their nearest fellow member."""
    c = centroid(members, "cluster").select("cluster", F.col("centroid").alias("_c"), "n").where("n >= 3").hint("merge")
    t = cut(members.join(c, "cluster").where(F.size("embedding") == F.size("_c")).select(
        "cluster", "id", cosine("embedding", "_c").alias("centroid_similarity"), F.col("embedding").alias("vec")))
    side = t.select(F.col("cluster").cast("string").alias("grp"), "id", "vec")
    near = knn_join(side, side, k=1, min_sim=-2.0, self_join=True).select("id", F.col("sim").alias("_s")).hint("merge")
    out = t.join(near, "id", "left").select(
        "cluster", "id", "centroid_similarity", F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0)).alias("max_member_similarity"))
    return out.where((F.col("centroid_similarity") < centroid_sim) | (F.col("max_member_similarity") < neighbour_sim))


def _verdict(role, shared, token_score):
    soft = F.coalesce(role, F.lit("event")).isin(*SOFT_ROLES)
    return (soft & ((shared < 1) | (token_score < 0.18))) | ((shared == 0) & (token_score < 0.14))


def metadata_suspicion(members: DataFrame) -> DataFrame:
    """Every article against the rest of its cluster: shared entities, token overlap, suspicious or not.

    A word is in the rest if the cluster uses it in more articles than this one, so word counts per
    cluster replace comparing each article with each other. Members: ``cluster, id, title, main_event,
    story_identity, article_type, entities``."""
    def counted(values):
        rows = members.select("cluster", "id", F.explode(values).alias("v"))
        df = rows.groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("df")).hint("merge")
        per = rows.join(df, ["cluster", "v"]).groupBy("cluster", "id").agg(
            F.count(F.lit(1)).alias("own"), F.count_if(F.col("df") > 1).alias("shared")).hint("merge")
        return per, df.groupBy("cluster").agg(F.count(F.lit(1)).alias("all"))

    words, all_words = counted(significant_tokens(identity_text()))
    names, _ = counted(norm_entities("entities"))
    t = (members.select("cluster", "id", "article_type")
         .join(words, ["cluster", "id"], "left").join(all_words, "cluster", "left")
         .join(names.select("cluster", "id", F.col("shared").alias("_names")), ["cluster", "id"], "left")
         .fillna(0, ["own", "shared", "all", "_names"]))
    rest_empty = F.col("all") - (F.col("own") - F.col("shared")) == 0
    score = F.when((F.col("own") == 0) | rest_empty, F.lit(0.0)).otherwise(F.col("shared") / F.col("all"))
    t = t.withColumns({"token_score": score, "shared_entities": F.col("_names")})
    return t.select("cluster", "id", "shared_entities", "token_score",
                    _verdict(F.col("article_type"), F.col("shared_entities"), F.col("token_score")).alias("suspicious"))


def cluster_suspicious(members: DataFrame) -> DataFrame:
    """Clusters with a suspicious member; a pair in which both are tells nothing."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("suspicious"))
    return metadata_suspicion(members).groupBy("cluster").agg(
        n.alias("articles"), bad.alias("suspicious_articles"),
        ((n >= 2) & (bad > 0) & ~((bad == n) & (n <= 2))).alias("suspicious"))


def _rest_words(articles: DataFrame, out: DataFrame) -> DataFrame:
    """``(cluster, id, token_score)`` of outliers against the identity lines of the rest of their cluster.

    A word is in the rest if more lines use it than the article's own, so counts per cluster serve every member."""
    line = significant_tokens(F.coalesce("story_identity", "main_event", "title"))
    lines = articles.select("cluster", "id", F.explode(line).alias("t"))
    df = lines.groupBy("cluster", "t").agg(F.count(F.lit(1)).alias("df")).hint("merge")
    every = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("every"))
    mine = lines.join(out, ["cluster", "id"], "left_semi").withColumn("own", F.lit(1)).hint("merge")
    alone = mine.join(df, ["cluster", "t"]).groupBy("cluster", "id").agg(F.count_if(F.col("df") == 1).alias("alone")).hint("merge")
    words = articles.join(out, ["cluster", "id"], "left_semi").select("cluster", "id", F.explode(significant_tokens(identity_text())).alias("t"))
    shared = words.join(mine, ["cluster", "id", "t"], "left").join(df, ["cluster", "t"], "left").groupBy("cluster", "id").agg(
        F.count(F.lit(1)).alias("words"), F.count_if(F.coalesce("df", F.lit(0)) - F.coalesce("own", F.lit(0)) >= 1).alias("both")).hint("merge")
    t = out.join(shared, ["cluster", "id"], "left").join(alone, ["cluster", "id"], "left").join(every, "cluster", "left").fillna(
        0, ["words", "both", "alone", "every"])
    rest = F.col("every") - F.col("alone")
    score = F.when((F.col("words") == 0) | (rest == 0), 0.0).otherwise(F.col("both") / (F.col("words") + rest - F.col("both")))
    return t.select("cluster", "id", score.alias("token_score"))


def _rest_entities(articles: DataFrame, out: DataFrame, limit: int = 15) -> DataFrame:
    """``(cluster, id, shared_entities)``: how many of an outlier's entities are in the merged list of the rest.

    The rest's list (see :func:`merge_entities`) differs from the cluster's only by what the article itself says: forms that
    nobody else has go, forms that only stood inside those come back, and what it says first is seen later. So a
    look at the first ``limit`` forms of the cluster and a few more is enough for every outlier."""
    some = articles.join(out.select("cluster").distinct(), "cluster", "left_semi").where("entities is not null")
    seen = cut_large(some.select("cluster", "id", F.posexplode("entities").alias("_p", "_e")).withColumn("_l", strip(F.lower("_e"))).where(
        "_l <> ''").groupBy("cluster", "_l", "id").agg(F.min("_p").alias("_p")))
    forms = seen.groupBy("cluster", "_l").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("id", "_p")).alias("first"))
    inside = cut_large(contained_forms(forms.select("cluster", "_l"), "cluster", "inner"))
    own = seen.join(out, ["cluster", "id"], "left_semi").select("cluster", "id", "_l")
    many = own.groupBy("cluster", "id").agg(F.count(F.lit(1)).alias("m")).hint("merge")
    kept = forms.join(inside.select("cluster", "_l").distinct(), ["cluster", "_l"], "left_anti")
    kept = kept.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("first"))).hint("merge")
    listed = out.join(many, ["cluster", "id"], "left").join(kept, "cluster").where(F.col("rn") <= limit + F.coalesce("m", F.lit(0))).select(
        "cluster", "id", "_l")
    lone = forms.where("df = 1").select("cluster", F.col("_l").alias("_in"), F.col("first.id").alias("id")).join(out, ["cluster", "id"], "left_semi")
    freed = inside.join(lone, ["cluster", "_in"]).groupBy("cluster", "id", "_l").agg(F.count(F.lit(1)).alias("gone")).join(
        inside.groupBy("cluster", "_l").agg(F.count(F.lit(1)).alias("all")), ["cluster", "_l"]).where(F.col("gone") == F.col("all")).select(
        "cluster", "id", "_l")
    near = listed.unionByName(freed).join(own.withColumn("own", F.lit(1)).hint("merge"), ["cluster", "id", "_l"], "left").join(
        forms.hint("merge"), ["cluster", "_l"]).where(F.col("df") - F.coalesce("own", F.lit(0)) >= 1)
    early = near.where(F.col("first.id") == F.col("id")).select("cluster", "id", "_l")
    later = early.join(seen.select("cluster", "_l", F.col("id").alias("other"), "_p"), ["cluster", "_l"]).where("other <> id").groupBy(
        "cluster", "id", "_l").agg(F.min(F.struct(F.col("other").alias("id"), "_p")).alias("second")).hint("merge")
    order = Window.partitionBy("cluster", "id").orderBy(F.coalesce("second", "first"))
    named = near.join(later, ["cluster", "id", "_l"], "left").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    counts = named.groupBy("cluster", "id").agg(F.count("own").alias("shared_entities")).hint("merge")
    return out.join(counts, ["cluster", "id"], "left").fillna(0, ["shared_entities"])


def suspicious_outliers(members: DataFrame, **limits) -> DataFrame:
    """Embedding outliers whose metadata does not fit the rest of their cluster either, by one rule at every size.

    The rest is described by one identity line per article and its merged entity list; both come from counts
    per cluster, not from a copy of the cluster per outlier."""
    out = cut_large(embedding_outliers(members.select("cluster", "id", "embedding"), **limits).select("cluster", "id"))
    articles = members.drop("embedding").join(out.select("cluster").distinct(), "cluster", "left_semi")
    scored = _rest_words(articles, out).join(_rest_entities(articles, out).hint("merge"), ["cluster", "id"]).hint("merge").join(
        articles.select("cluster", "id", "article_type"), ["cluster", "id"])
    return scored.where(_verdict(F.col("article_type"), F.col("shared_entities"), F.col("token_score"))).select("cluster", "id")


def _parted(members: DataFrame, odd: DataFrame) -> DataFrame:
    odd = odd.withColumn("_odd", F.lit(True)).hint("merge")
    t = members.select("cluster", "id").join(odd, ["cluster", "id"], "left")
    core = t.where("_odd is null").select("cluster").distinct().withColumn("_core", F.lit(True)).hint("merge")
    return t.join(core, "cluster", "left").select(
        "cluster", "id", F.when(F.col("_odd") & F.col("_core"), F.col("id")).otherwise(F.lit(0)).alias("part"))


def split_outliers(members: DataFrame, **limits) -> DataFrame:
    """``(cluster, id, part)``: suspicious outliers become parts of their own (part = their id) as long as a
    core (part 0) remains."""
    return _parted(members, cut_large(suspicious_outliers(members, **limits)))


# ---- verdict cache ------------------------------------------------------------------

def fingerprints(members: DataFrame, key: str = "cluster") -> DataFrame:
    """Comma-joined sorted member ids of every cluster."""
    return members.groupBy(key).agg(
        F.array_sort(F.collect_list("id")).alias("article_ids")).withColumn(
        "fingerprint", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), ","))


def decision_rows(verdicts: DataFrame) -> DataFrame:
    """Cache rows from ``article_ids, verdict, model``: coherent rows carry a title, others carry groups."""
    v = F.col("verdict")
    ids = F.array_sort("article_ids")
    return verdicts.where("verdict is not null").select(
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("fingerprint"), ids.alias("article_ids"),
        v["coherent"].alias("coherent"), F.when(v["coherent"], v["title"]).alias("title"),
        F.when(v["coherent"], v["summary"]).alias("summary"), F.when(~v["coherent"], v["groups"]).alias("groups"),
        *[c for c in ("model", "prompt_version", "diagnostics", "created_at") if c in verdicts.columns])


def valid_decisions(cache: DataFrame) -> DataFrame:
    """Rows that can be reused: coherent with a title, or split into at least two non-empty groups."""
    groups = F.filter("groups", lambda g: F.size(g) > 0)
    ok = F.when(F.col("coherent"), non_empty("title").isNotNull()).otherwise(F.size(groups) >= 2)
    return cache.where(F.coalesce(ok, F.lit(False))).withColumn("groups", F.when(~F.col("coherent"), groups))


def reuse_by_fingerprint(members: DataFrame, cache: DataFrame) -> DataFrame:
    return fingerprints(members).join(
        valid_decisions(cache).select("fingerprint", "coherent", "title", "summary", "groups").hint("merge"), "fingerprint")


def prior_splits(members: DataFrame, cache: DataFrame) -> DataFrame:
    """``(cluster, id, part)`` for clusters of three or more that join articles an earlier verdict had put into
    different groups. The latest such verdict counts; articles it does not know stand alone (negative part)."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select("cluster").hint("merge")
    big = members.select("cluster", "id").join(size, "cluster", "left_semi")
    split = (valid_decisions(cache).where(~F.col("coherent"))
             .select("fingerprint", "created_at", F.posexplode("groups").alias("g", "ids"))
             .select("fingerprint", "created_at", "g", F.explode("ids").alias("id"))).hint("merge")
    seen = big.join(split, "id")
    hit = (seen.groupBy("cluster", "fingerprint", "created_at")
           .agg(F.count_distinct("id").alias("n"), F.count_distinct("g").alias("gs")).where("n >= 2 and gs >= 2"))
    w = Window.partitionBy("cluster").orderBy(F.col("created_at").desc(), "fingerprint")
    latest = hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("cluster", "fingerprint").hint("merge")
    parts = (seen.join(latest, ["cluster", "fingerprint"]).groupBy("cluster", "id").agg(F.min("g").alias("part"))).hint("merge")
    return (big.join(latest.select("cluster"), "cluster", "left_semi").join(parts, ["cluster", "id"], "left")
            .select("cluster", "id", F.coalesce("part", -F.col("id") - 1).cast("bigint").alias("part")))


def regroup(parts: DataFrame) -> DataFrame:
    """New cluster keys: the smallest id of each part."""
    head = parts.groupBy("cluster", "part").agg(F.min("id").alias("_new")).hint("merge")
    return parts.join(head, ["cluster", "part"]).select(F.col("_new").alias("cluster"), "id")


CACHE_COLUMNS = ("fingerprint string, article_ids array<bigint>, coherent boolean, title string, summary string, "
                 "groups array<array<bigint>>, model string, created_at timestamp_ntz")


def _groups(split: DataFrame) -> DataFrame:
    """``(cluster, article_ids, groups)`` of clusters ``(cluster, id, part)``, members and groups in order."""
    per = split.groupBy("cluster", "part").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return per.groupBy("cluster").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("article_ids"), F.array_sort(F.collect_list("ids")).alias("groups"))


def settle(members: DataFrame, articles: DataFrame, cache: DataFrame, stories: DataFrame | None = None, judge=None, model: str = "",
           now=None, max_size: int = vocab.MAX_CLUSTER_SIZE, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every cluster through prior splits, stored verdicts, the judge and the outlier guard, until none is split any more.

    Returns ``(members, titles, decisions)``: clusters keyed by their smallest member, their titles (``reused`` if stored), and the
    new rows for the cache. An open cluster is, in this order: left alone if it has one member; split as an earlier verdict did
    (three or more members); given the title of the story with the same members (``stories``: ``fingerprint, title, summary``) or of a
    coherent verdict, if its metadata look sound and it has no suspicious outlier; split by a stored verdict on just these members;
    judged. ``judge(listing, old_title)`` is called inside the tasks and its answer parsed; without a judge, or without a usable
    answer, the first article gives the title. A cluster judged coherent loses its suspicious outliers. With a column
    ``embedding`` in ``articles`` outliers are looked for, else there are none."""
    used = ("id", "title", "summary", "main_event", "story_identity", "article_type", "entities", "embedding")
    articles = cut_large(articles.select(*[c for c in used if c in articles.columns]))  # read in every round
    cache = cut_large(cache.select("fingerprint", "coherent", "title", "summary", "groups", "created_at"))
    known = valid_decisions(cache)
    whole = known.where("coherent").select("fingerprint", "title", "summary", F.lit(1).alias("_o"))
    if stories is not None:
        whole = whole.unionByName(stories.select("fingerprint", "title", "summary", F.lit(0).alias("_o")))
    whole = cut_large(whole.groupBy("fingerprint").agg(F.min_by(F.struct("title", "summary"), "_o").alias("k")))
    apart = cut_large(known.where(~F.col("coherent")).select("fingerprint", "groups"))
    at = F.lit(now).cast("timestamp_ntz") if now is not None else F.lit(None).cast("timestamp_ntz")
    open_ = cut_large(regroup(members.select("cluster", "id", F.lit(0).alias("part"))))
    done, given, decisions = [], [], []
    while not open_.isEmpty():  # what stays open is in smaller clusters
        prior = cut_large(prior_splits(open_, cache))
        left = cut_large(open_.join(prior.select("cluster").distinct(), "cluster", "left_anti"))
        prints = cut_large(fingerprints(left))
        several = prints.where(F.size("article_ids") > 1)
        rows = left.join(several.select("cluster"), "cluster", "left_semi").join(articles, "id")
        odd = cut_large(suspicious_outliers(rows, **limits)) if "embedding" in articles.columns else left.where("false")
        hit = several.join(whole, "fingerprint").hint("merge")
        doubted = cluster_suspicious(rows.join(hit.select("cluster"), "cluster", "left_semi")).where("suspicious").select("cluster").hint("merge")
        kept = cut_large(hit.join(doubted, "cluster", "left_anti").join(odd, "cluster", "left_anti").select("cluster", "k"))
        stored = _split_by(several.join(kept, "cluster", "left_anti").join(apart, "fingerprint").select("cluster", "groups"), left)
        rest = cut_large(several.join(kept, "cluster", "left_anti").join(stored.select("cluster").distinct(), "cluster", "left_anti"))
        judged = judged_clusters(left.join(rest, "cluster", "left_semi").join(articles, "id"), judge, max_size)
        wrong = _split_by(judged.where(~F.col("coherent")).select("cluster", "groups"), left) if judge else left.where("false").withColumn("part", F.lit(0))
        fine = rest.select("cluster").join(wrong.select("cluster").distinct(), "cluster", "left_anti").hint("merge")
        parts = cut_large(_parted(left.join(fine, "cluster", "left_semi"), odd))
        guarded = parts.where("part <> 0").select("cluster").distinct().hint("merge")
        torn = parts.join(guarded, "cluster", "left_semi")
        whole_ones = left.join(wrong.unionByName(stored).select("cluster").distinct().union(guarded).hint("merge"), "cluster", "left_anti")
        done.append(whole_ones.select("cluster", "id").unionByName(regroup(torn)))
        titled = judged.where("coherent").join(guarded, "cluster", "left_anti")
        given += [titled.select("cluster", F.struct("title", "summary").alias("k"), F.lit(False).alias("reused")),
                  kept.withColumn("reused", F.lit(True))]
        no_groups, no_text = F.lit(None).cast("array<array<bigint>>"), F.lit(None).cast("string")
        split = _groups(wrong.unionByName(torn)).select("cluster", "groups").join(prints, "cluster").select(
            "fingerprint", prints["article_ids"], F.lit(False).alias("coherent"), no_text.alias("title"), no_text.alias("summary"), "groups")
        good = titled.join(prints, "cluster").select("fingerprint", prints["article_ids"], "coherent", "title", "summary", no_groups.alias("groups"))
        decisions += [split.withColumns({"model": F.lit(model), "created_at": at}), good.withColumns({"model": F.lit(model), "created_at": at})]
        open_ = cut_large(regroup(prior.unionByName(stored).unionByName(wrong)))
    spark = members.sparkSession

    def together(frames, schema):
        out = spark.createDataFrame([], schema)
        for f in frames:
            out = out.unionByName(f)
        return cut_large(out)
    settled = together(done, "cluster bigint, id bigint")
    given = together(given, "cluster bigint, k struct<title:string,summary:string>, reused boolean")
    heads = settled.join(articles, "id").groupBy("cluster").agg(F.min(F.struct("id", "title", "summary")).alias("f"))
    titles = cut_large(heads.join(given, "cluster", "left").select(
        "cluster", F.coalesce("k.title", "f.title").alias("title"),
        F.when(F.col("k").isNotNull(), F.col("k.summary")).otherwise(F.col("f.summary")).alias("summary"),
        F.coalesce("reused", F.lit(False)).alias("reused")))
    return settled, titles, together(decisions, CACHE_COLUMNS)


def _split_by(groups: DataFrame, members: DataFrame) -> DataFrame:
    """``(cluster, id, part)`` of the clusters that their ``groups`` really divide; members in no group are left out."""
    named = groups.select("cluster", F.posexplode("groups").alias("part", "ids")).select("cluster", F.explode("ids").alias("id"), F.col("part").cast("bigint").alias("part"))
    named = named.join(members.hint("merge"), ["cluster", "id"], "left_semi").groupBy("cluster", "id").agg(F.min("part").alias("part"))
    several = named.groupBy("cluster").agg(F.count_distinct("part").alias("_n")).where("_n >= 2").select("cluster").hint("merge")
    return cut_large(named.join(several, "cluster", "left_semi"))


def judged_clusters(rows: DataFrame, judge, max_size: int) -> DataFrame:
    """``(cluster, coherent, title, summary, groups)`` of the judge's usable answers; a cluster listed in parts is coherent if all are."""
    from ..functions.hooks import cluster_listing
    from ..functions.hooks import judge as ask
    from ..functions.parsing import parse_coherence

    schema = "cluster bigint, coherent boolean, title string, summary string, groups array<array<bigint>>"
    if judge is None:
        return rows.sparkSession.createDataFrame([], schema)
    listings = cut_large(cluster_listing(rows, max_size).withColumn("old_title", F.lit(None).cast("string")))
    answers = ask(listings, judge)
    v = listings.join(answers, ["cluster", "part"]).select("cluster", "part", "article_ids", parse_coherence("answer", "article_ids").alias("v")).where(
        "v is not null")
    own = F.when(F.col("v.coherent"), F.array("article_ids")).otherwise(F.col("v.groups"))
    return cut_large(v.groupBy("cluster").agg(F.bool_and("v.coherent").alias("coherent"), F.min_by("v.title", "part").alias("title"),
                                        F.min_by("v.summary", "part").alias("summary"), F.flatten(F.collect_list(own)).alias("groups")))


def apply_verdicts(members: DataFrame, articles: DataFrame, cache: DataFrame, stories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(members, titles)`` of :func:`settle` without a judge: stored verdicts only."""
    return settle(members, articles, cache, stories)[:2]
