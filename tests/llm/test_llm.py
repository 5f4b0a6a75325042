"""The training-data operators against plain definitions, their SQL and hard inputs."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressweave.llm import cascade, chat, decontam, htmltext, langid, linededup, neardup, ruleensemble, tokenbin, wordbpe
from pressweave.llm.catalog import ORACLES, QUERIES, vocabulary
from llmprose import prose


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


# ---- 1 language -------------------------------------------------------------------

def plain_length(text, counts, order):
    """Nats of a text under one language, straight from the definition."""
    total, data = 0.0, bytes(order) + text.encode()
    for i in range(order, len(data)):
        out, done = set(), False
        for k in range(order, -1, -1):
            seen = counts.get((k, data[i - k:i]))
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                total += np.log(whole / left[data[i]])
                done = True
                break
            total += np.log(whole / len(left))
            out |= set(left)
        if not done:
            total += np.log(256 - len(out))
    return total


def test_code_lengths_follow_the_definition(spark):
    order, texts = 3, ["abracadabra", "abcab", "aé bracket"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    trees = langid.learn(docs, order=order)
    counts = {}
    for t in texts:
        data = bytes(order) + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault((k, data[i - k:i]), {}).setdefault(data[i], 0)
                counts[k, data[i - k:i]][data[i]] += 1
    probe = ["abra", "zebra é", "aaaa", "", "cab abracadabra"]
    from pressweave.llm.common import flat
    got = langid.Scorer(trees).texts(*flat(pa.array(probe)))[:, 0]
    assert np.allclose(got, [plain_length(t, counts, order) for t in probe])


def test_language_held_out(spark, sf):
    got = QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_language_hard(hard, nothing):
    trees = langid.learn(hard)
    got = langid.identify(hard, trees).collect()
    assert len(got) == hard.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 7)} == {"und"}
    assert langid.identify(nothing, langid.learn(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(hard, langid.learn(nothing)).collect()} == {"und"}


# ---- 2 lines ----------------------------------------------------------------------

def test_repeated_passage_goes_and_clean_text_stays(spark):
    passage = ". ".join(prose(90 + i, 8) for i in range(14)) + ". "
    rows = [(i, prose(i, 20) + ". " + (passage if i in (3, 5, 8) else "") + prose(50 + i, 20) + ".") for i in range(10)]
    got = dict(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    for i, t in rows:
        assert got[i] == t if i not in (5, 8) else len(got[i]) < len(t) - len(passage) // 2


@pytest.mark.parametrize("n", [1, 3, 5])
def test_planted_passages_go_whole(spark, n):
    import corpus_pipeline as cp

    rows, want = [], {}
    for p in range(8):
        size = 50 + p
        passage = "".join(prose(1000 * n + 10 * p + k, size // n + (k < size % n)) + ". " for k in range(n))
        for c in range(3):
            key = 10 * p + c
            before, after = prose(7000 + 100 * n + key, 12) + ". ", prose(8000 + 100 * n + key, 12) + ".\n\n" + prose(9000 + 100 * n + key, 9)
            rows.append((key, before + passage + after, 0))
            want[key] = before + (passage if c == 0 else "") + after
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, df, "").collect()}
    assert {k: got[k][0] for k in want} == want
    assert all(got[k][1] == len(want[k]) for k in want if k % 10)


def test_lines_hard(hard, nothing):
    got = linededup.dedup_lines(hard)
    assert got.columns == hard.columns and got.count() == hard.count()
    assert {r.text for r in got.where("doc_id = 2").collect()} == {None}
    assert linededup.dedup_lines(nothing).count() == 0


def test_whole_passages_hard(hard, nothing):
    whole = linededup.dedup_lines(hard, whole=True)
    assert whole.columns == hard.columns and whole.count() == hard.count()
    assert {r.text for r in whole.where("doc_id = 2").collect()} == {None} and {r.text for r in whole.where("doc_id = 7").collect()} == {" \n\t "}
    assert linededup.dedup_lines(nothing, whole=True).count() == 0


# ---- 3 decontamination ------------------------------------------------------------

def test_short_and_repeated_items(spark):
    items = spark.createDataFrame([(1, "Alpha  BETA"), (2, "one two three four five six seven eight nine ten eleven"), (3, "alpha beta"),
                                   (4, None), (5, "..."), (10, "É")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x alpha, beta alpha beta"), (2, "two three four five six seven eight nine ten eleven!"), (3, None),
                                  (4, "two three four"), (5, "é É")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (5, 4, 2), 2: (10, 10, 1), 3: (0, 0, 0), 4: (3, 0, 0), 5: (2, 1, 1)}
    assert {r.doc_id for r in decontam.clean_documents(docs, items).collect()} == {3, 4}


def test_decontamination_hard(hard, nothing, spark):
    items = spark.createDataFrame([(1, prose(1, 60)), (None, prose(3, 11))], "item_id bigint, text string")
    got = decontam.contamination(hard, items).collect()
    assert len(got) == hard.count() and sorted(r.doc_id for r in got if r.contaminated) == [1, 4, 4, 6]
    assert decontam.contamination(nothing, items).count() == 0
    assert decontam.contamination(hard, items.where("false")).where("contaminated").count() == 0
    assert decontam.clean_documents(hard, items).columns == hard.columns


# ---- 4 cascade --------------------------------------------------------------------

def test_order_does_not_change_verdicts(spark, sf):
    texts = pa.array([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()] + ["", "a " * 400])
    first = cascade.run_rules(cascade.Rows(texts), cascade.RULES) < 0
    for rules in (cascade.RULES[::-1], cascade.RULES[3:] + cascade.RULES[:3]):
        assert (first == (cascade.run_rules(cascade.Rows(texts), rules) < 0)).all()
    order = cascade.ordered(cascade.RULES, cascade.Prices(
        {"rule symbols": 1.0, "rule short": 1.0, "rule repeats": 0.01, "rule line_copies": 1.0}, {},
        {"0010000": 50, "1000000": 10, "0100000": 10, "0000000": 30}))
    assert [r.name for r in order[:3]] == ["repeats", "symbols", "short"]


def test_shared_features_are_priced_once_and_selectivity_is_what_is_left():
    rules = [cascade.Rule(n, lambda r: None) for n in ("a", "b", "c")]
    seconds = {"rule a": 1.0, "rule b": 1.0, "rule c": 1.0, "words": 9.0, "x": 4.0}
    needs = {"rule a": frozenset({"x"}), "rule b": frozenset({"y"}), "y": frozenset({"words"}), "rule c": frozenset({"words"})}
    # a: 40 / 5; then c has 20 left to reject and b 22, both with the same words to split; after b they are free to c
    met = {"100": 10, "101": 30, "010": 12, "011": 10, "001": 10, "000": 28}
    assert [r.name for r in cascade.ordered(rules, cascade.Prices(seconds, needs, met))] == ["a", "b", "c"]
    # with the words known before, c rejects 50 for a second and comes first
    assert cascade.ordered(rules, cascade.Prices(seconds | {"words": 0.0}, needs, met))[0].name == "c"


def test_prices_of_a_sample(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, "# # # " + "many more words stand in this text " * 3), (3, None)],
                                 "doc_id bigint, text string").na.fill("", ["text"]).coalesce(1)
    prices = cascade.measure(docs)
    assert "words" in prices.features("rule one_word") and sum(prices.met.values()) == 3
    position = [r.name for r in cascade.RULES].index("short")
    assert sum(n for marks, n in prices.met.items() if marks[position] == "1") == 2
    known = cascade.measure(docs, known=cascade.BASE)
    assert not {"words", "n_words", "n_symbols"} & set(known.seconds) and "n_top_word" in known.seconds
    assert cascade.measure(docs.limit(0)) == cascade.Prices({}, {}, {})


def test_rows_taken_keep_their_words():
    rows = cascade.Rows(pa.array(["a b a", "c", "", "b b b b"]))
    rows["n_top_word"]
    some = rows.take(np.array([True, False, True, True]))
    assert some.words()[1].tolist() == [3, 0, 4] and not some.spent
    del some.known["n_top_word"]
    assert some["n_top_word"].tolist() == [2, 0, 4]


def test_cascade_hard(hard, nothing):
    got = cascade.quality_cascade(hard, counts=True).collect()
    assert len(got) == hard.count() and not any(r.kept for r in got if r.doc_id in (2, 3, 5, 7))
    assert cascade.quality_cascade(nothing).count() == 0


# ---- 5 token output ---------------------------------------------------------------

def test_elias_fano_select():
    rng = np.random.default_rng(0)
    for ends in (np.cumsum(rng.integers(0, 500, 1000)), np.zeros(5, dtype=np.int64), np.array([7]), np.zeros(0, dtype=np.int64)):
        ef = tokenbin.EliasFano(len(ends), *tokenbin.ef_encode(ends))
        assert (ef.all() == ends).all() and [ef.select(k) for k in range(len(ends))] == ends.tolist()


def test_token_binary_equals_the_library(hard, nothing, spark):
    import zlib

    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text) for r in hard.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = tokenbin.binary_round_trip(hard, path, 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokenbin.binary_round_trip(nothing, path, 2).count() == 0
    odd = ["a<|endoftext|>b", "x  y\n\n z 's", "don't  ", "a  b 　 c", "été, a.b"]
    ids, ends = tokenbin.encode_texts(path, pa.array(odd), None)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in odd]


# ---- 6 near duplicates ------------------------------------------------------------

def plain_components(rows, width, percent):
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_all_pairs(spark, width):
    rows, n = [], 0
    for g in range(12):
        base = prose(g, 40 + 8 * g).split()
        for c in range(6):
            w = list(base)
            for e in range(c):
                w[(7 * e + 3 * c) % len(w)] = f"edit{g}_{c}_{e}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width=width).collect()}
    assert got == plain_components(rows, width, 80)


def test_near_duplicates_hard(hard, nothing):
    got = neardup.near_duplicates(hard).collect()
    assert len(got) == hard.count() and {r.component_id for r in got if r.doc_id in (1, 4)} == {1}
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.one_of_each(hard).columns == hard.columns


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d"])
def test_a_short_document_alone_in_its_partition(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1)
    assert [(r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=5).collect()] == [(1, 1, True)]
    assert neardup.one_of_each(df).count() == 1


# ---- 7 classifier -----------------------------------------------------------------

def test_classifier_held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op7_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert got and sum(r.predicted == r.quality for r in got) / len(got) >= 0.95


def test_compiled_rules_equal_plain_ones():
    rule = ruleensemble.PathRule((("words", True, 2.0), ("digits", False, 0.5)))
    model = ruleensemble.RuleModel(0.5, ((rule, 2.0),))
    text = str(model.score())
    assert "words" in text and "digits" in text


@pytest.fixture(scope="module")
def measured(spark):
    """400 rows of random statistics; label 1 mostly where there are many words and few symbols."""
    rng = np.random.default_rng(4)
    values = rng.random((400, len(ruleensemble.STATISTICS)))
    at = {n: i for i, n in enumerate(ruleensemble.STATISTICS)}
    good = (values[:, at["words"]] > 0.4) & (values[:, at["symbols"]] < 0.6)
    label = np.where(rng.random(400) < 0.1, ~good, good).astype(int)
    rows = [(i, *map(float, v)) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"{n} double" for n in ruleensemble.STATISTICS)).repartition(3)
    return table, spark.createDataFrame(list(enumerate(label.tolist())), "doc_id bigint, quality int"), values, label


def holds(rule, values):
    at = {n: i for i, n in enumerate(ruleensemble.STATISTICS)}
    out = np.ones(len(values), dtype=bool)
    for name, at_most, threshold in rule.conditions:
        out &= values[:, at[name]] <= threshold if at_most else values[:, at[name]] > threshold
    return out


def test_learned_rules_scored_in_numpy(measured):
    table, labels, values, label = measured
    model = ruleensemble.learn(table, labels)
    z = model.intercept + sum(w * holds(r, values) for r, w in model.rules)
    chance = 1 / (1 + np.exp(-z))
    got = ruleensemble.classify(table, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in got], chance) and [r["predicted"] for r in got] == (chance >= 0.3).astype(int).tolist()
    assert ((chance >= 0.5) == label).mean() > 0.85
    # the lasso's optimum: a kept rule's gradient meets the penalty on its standardised weight
    for rule, weight in model.rules:
        x = holds(rule, values).astype(float)
        if abs(weight) > 0.05:
            assert abs((x * (chance - label)).mean() + 0.002 * x.std(ddof=1) * np.sign(weight)) < 0.0006


def test_paths_are_the_nodes_of_the_trees(measured, spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Vectors

    table, labels, values, _ = measured
    train = VectorAssembler(inputCols=list(ruleensemble.STATISTICS), outputCol="features").transform(
        table.join(labels, "doc_id").withColumn("label", F.col("quality").cast("double")))
    for tree in RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(train).trees:
        rules = ruleensemble.paths([tree])
        assert len(rules) == tree.numNodes - 1
        met = np.stack([holds(r, values) for r in rules], axis=1)
        leaf = [tree.predictLeaf(Vectors.dense(v)) for v in values]
        assert len({(n, tuple(m)) for n, m in zip(leaf, met.tolist())}) == len(set(leaf)) == len({tuple(m) for m in met.tolist()})


def test_classifier_hard(hard, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    kept = ruleensemble.reject_low_quality(hard, labels)
    assert kept.columns == hard.columns and kept.count() == hard.count()
    assert ruleensemble.reject_low_quality(nothing, labels.where("false")).count() == 0


# ---- 8 pages ----------------------------------------------------------------------

def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
      <article><h1>Head &amp; line</h1><p>First   <b>bold</b>&nbsp;text<br>more<p>Second<script>var x="</p>";</script></p>
      <form><input value=1>Mail</form></article><div id="comments"><p>Nice post, really nice and long comment.</p></div>
      <aside>Side</aside><footer>&copy; us</footer>"""
    assert htmltext.main_text(page) == "Head & line\nFirst bold text more\nSecond"
    bare = "<div class=x><div><a href=1>l1</a> <a href=2>l2</a></div><div><p>" + "long text here " * 9 + "</p><p>short</p></div></div>"
    assert htmltext.main_text(bare).endswith("\nshort") and "l1" not in htmltext.main_text(bare)
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav>x</nav>") == ""
    assert htmltext.main_text("plain &lt;text") == "plain <text"
    assert htmltext.main_text("<p" * 2000) is not None and htmltext.main_text('<a href="' * 3000) is not None


def test_sibling_articles_are_taken_like_sibling_blocks():
    parts = [[f"Part{i} " + prose(10 * i + k, 60) for k in range(10 if i == 1 else 2)] for i in range(4)]
    for tag in ("article", "div"):
        page = "<body><nav><a href=1>Home</a></nav>" + "".join(
            f"<{tag}>" + "".join(f"<p>{t}</p>" for t in part) + f"</{tag}>" for part in parts) + "<footer>f</footer>"
        assert htmltext.main_text(page).split("\n") == [t for part in parts for t in part], tag


def test_loose_class_words_and_source_lists_stay():
    body = "<p>" + prose(5, 80) + "</p><p>" + prose(6, 80) + "</p>"
    menu = "<div class='share-menu'><a href=1>Tweet it</a> <a href=2>Post it</a></div>"
    for opened, closed in (('<article class="post comments-open">', "</article>"), ('<div class="content no-sidebar">', "</div>"),
                           ('<div class="entry has-share-buttons">', "</div>"), ('<div id="social"><article>', "</article></div>")):
        got = htmltext.main_text(f"<body><div class=nav><a href=0>Home</a></div>{opened}{body}{menu}{closed}<div class=sidebar>Side words</div></body>")
        assert got.split("\n") == [prose(5, 80), prose(6, 80)], opened
    sources = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"
    assert htmltext.main_text(f"<article>{body}{sources}</article>").endswith("First source\nSecond source")


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 20_000 + "text", "<div><p>a b c" * 20_000, "<ul><li>x" * 20_000, "<div><a>x</a><a>y</a></div>" * 20_000):
        htmltext.main_text(page)
    assert time.perf_counter() - began < 20  # a search of the whole stack per tag takes minutes


def test_pages_hard(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>x</p>")], "page_id bigint, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extract_pages(df).collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0)]


# ---- 9 chat -----------------------------------------------------------------------

def test_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"conversations":[{"from":"human","value":"a"},'
               '{"from":"gpt","value":"b"}]}', '{"output":"b","instruction":"a"}', '{"prompt":"a","completion":"b"}',
               '{"instruction":"a","input":"","output":"b"}', '{"strange":1}', "broken {", None, '{"messages":[]}']
    df = spark.createDataFrame(list(enumerate(records)), "conv_id int, record string")
    got = {r.conv_id: r for r in chat.format_chats(df, keep=("conv_id",)).collect()}
    want = [("user", "a"), ("assistant", "b")]
    for i in range(5):
        assert [tuple(t) for t in got[i].turns] == want, i
    assert all(got[i].turns is None and got[i].layout is None for i in (5, 6, 7)) and got[8].turns == []


def test_control_strings_come_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|text|>", "\\<|", "<\\|", "<<s>", "<<SYS>><</SYS>>", "", "é\n\\n"]
    rows = [(1, i, "assistant" if i % 2 else nasty[i], t) for i, t in enumerate(nasty)]
    df = chat.format_chats(chat.conversation_records(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")), keep=("conv_id",))
    got = df.select("formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert [tuple(t) for t in got.t] == [(r, t) for _, _, r, t in rows]
    assert got.l == "".join(t for _, _, r, t in rows if r == "assistant")
    inside = got.formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>\n", "")
    assert not any(c in inside for c in chat.CONTROL)


def test_records_that_no_variant_holds(spark):
    text = 'é"\\ \n a:b,{}[] 12 null <role> <|end|> ' * 450_000  # 17 million characters
    many = [("user" if i % 2 == 0 else "assistant", f"turn {i} " * 16) for i in range(100_000)]
    parts = [spark.createDataFrame([(1, 0, "user", text[:len(text) // 450_000]), (1, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
             .withColumn("text", F.when(F.col("turn") == 0, F.repeat("text", F.lit(450_000))).otherwise(F.col("text"))),
             spark.range(100_000).selectExpr("2 AS conv_id", "CAST(id AS int) AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
                                             "repeat(concat('turn ', id, ' '), 16) AS text")]
    records = chat.conversation_records(parts[0].unionByName(parts[1]))
    assert records.where("octet_length(record) > 16 << 20").count() == 2
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(records, keep=("conv_id",))).collect()}
    for i, turns in ((1, [("user", text), ("assistant", "b")]), (2, many)):
        assert got[i].n_turns == len(turns)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    long = "concat(%s, repeat('long ', 4000000), %s)"
    odd = spark.range(1).selectExpr("inline(array(" + ",".join(f"struct({i} AS conv_id, " + long % (repr(a), repr(b)) + " AS record)" for i, (a, b) in enumerate((
        ('{"output":"b","instruction":"', '"}'), ('{"prompt":"', '"}'), ('{"messages":[{"role":"user","content":"', '"}]'), ('{"prompt":"', '","response":["a"]}')))) + "))")
    assert {r.conv_id: r.layout for r in chat.canonical_turns(odd, keep=("conv_id",)).collect()} == {0: "instruction", 1: None, 2: None, 3: None}


# ---- 10 BPE -----------------------------------------------------------------------

def test_bpe_equals_the_library(spark, sf, hard, nothing):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    rows += [(r.doc_id, r.text) for r in hard.collect()]
    rows += [(-i, t) for i, t in enumerate(["ΑΣ ΟΔΟΣ", "a<|endoftext|>'s", "İI ǅ é", "aaaaaaaa aaa", "it's 12 ⅷ"], 1)]
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, wordbpe.round_trip(df, path).collect()), key=str) == sorted(want, key=str)
    coded = wordbpe.encode_documents(df.where("doc_id > 0"), path)
    assert {r.doc_id: len(r.ids) for r in coded.collect()} == {k: n for k, n, _, _ in want if k and k > 0}
    back = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in wordbpe.decode_documents(coded, path).collect()}
    assert back == {k: d for k, _, _, d in want if k and k > 0}
    assert wordbpe.round_trip(nothing, path).count() == 0


def test_bpe_takes_small_slices_and_remembers_few_words(monkeypatch):
    class Frame:  # runs the step on batches of this process
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(wordbpe, "pick", lambda docs, *names: docs)
    path = vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"w{i}x{j}" for j in range(2_500)) for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100), pa.int64()), "text": pa.array(texts)})
    for run in (wordbpe.round_trip(Frame(), path, with_ids=True), wordbpe.encode_documents(Frame(), path)):
        sizes = [part.num_rows for part in run([batch])]
        assert sum(sizes) == 100 and max(sizes) * len(texts[0]) <= 1 << 20
    assert len(wordbpe.loaded(path).coded.at) <= 100_000


# ---- pipeline ---------------------------------------------------------------------

def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, sf))
        sizes.append(docs.count())
        assert name == "bpe" or docs.columns == names
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_rows_that_share_a_key_keep_their_own_links(spark):
    a, b = prose(31, 80), prose(32, 80)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (9, prose(33, 80)), (9, a)], "doc_id bigint, text string")
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=2).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (9, 1, False), (9, 9, True)]
    left = neardup.one_of_each(docs, width=2).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 1, 9] and [r["text"] for r in left if r["doc_id"] == 9] == [prose(33, 80)]
