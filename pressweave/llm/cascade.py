"""Quality rules as a short-circuit cascade.

Each rule rejects a document by some of its counts. On a bounded sample every feature is priced once, apart from the
rules that share it, and every row's verdicts under all rules are kept. The order is then greedy: next comes the rule
that rejects most per second of those rows that no earlier rule rejects, and it pays only for features that no earlier
rule has computed. A document that one rule rejects is not shown to the next. Whatever the order, the documents kept
are the same.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, flat, map_slices, per_row, pick, starts_of, words_of

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
INSIDE = np.zeros(256, dtype=bool)
INSIDE[0x80:0xC0] = True
WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB], dtype=np.uint64)


class Rows:
    """Texts and what is already known about them; every feature is computed when first asked for."""

    def __init__(self, texts: pa.Array, known: dict | None = None, words: tuple | None = None):
        self.texts, self.known, self._words = texts, known or {}, words
        self.spent: dict[str, float] = {}  # seconds of every feature computed here, without those it asked for
        self.needs: dict[str, set[str]] = {}  # what every feature, or the rule under way, asked for
        self._open: list[list] = []

    def __len__(self):
        return len(self.texts)

    def __getitem__(self, name: str) -> np.ndarray:
        self._asked(name)
        if name not in self.known:
            self.known[name] = self.timed(name, lambda: FEATURES[name](self))
        return self.known[name]

    def _asked(self, name: str) -> None:
        if self._open:
            self.needs[self._open[-1][0]].add(name)

    def timed(self, name: str, make: Callable):
        """``make()``, its seconds booked under ``name`` but for those of features it asks for."""
        self.needs.setdefault(name, set())
        self._open.append([name, 0.0])
        began = time.perf_counter()
        made = make()
        took = time.perf_counter() - began
        self.spent[name] = took - self._open.pop()[1]
        if self._open:
            self._open[-1][1] += took
        return made

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, equal for equal words, and each row's count."""
        def split():
            words, counts = words_of(self.texts)
            return np.asarray(words.dictionary_encode().indices).astype(np.int64), counts
        self._asked("words")
        if self._words is None:
            self._words = self.timed("words", split)
        return self._words

    def take(self, keep: np.ndarray) -> Rows:
        if keep.all():
            return self
        words = self._words and (self._words[0][np.repeat(keep, self._words[1])], self._words[1][keep])
        return Rows(self.texts.filter(pa.array(keep)), {k: v[keep] for k, v in self.known.items()}, words)


def count_bytes(rows: Rows, table: np.ndarray) -> np.ndarray:
    data, off = flat(rows.texts)
    return per_row(table[data], off)


def _repeat_words(rows: Rows) -> np.ndarray:
    """Words that lie in a 5-word window found at least twice in the text."""
    ids, counts = rows.words()
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(len(counts), dtype=np.int64)
    key = doc[:n].astype(np.uint64) * _MIX[WINDOW]
    for j in range(WINDOW):
        key += ids[j:n + j].astype(np.uint64) * _MIX[j]
    inside = doc[:n] == doc[WINDOW - 1:]
    ordered = np.sort(key[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    maybe = np.flatnonzero(inside & (twice[at] == key)) if len(twice) else np.zeros(0, dtype=np.int64)
    columns = [doc[maybe], *(ids[maybe + j] for j in range(WINDOW))]  # equal keys are compared word by word
    order = np.lexsort(columns)
    same = np.ones(max(len(maybe) - 1, 0), dtype=bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    again = np.zeros(len(maybe), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    places = maybe[order[again]]
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    step[places] += 1
    step[places + WINDOW] -= 1
    return per_row(np.cumsum(step[:-1]) > 0, starts_of(counts))


def _lines(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """``(lines with a word, those equal to an earlier line)``."""
    lists = pc.split_pattern(rows.texts, "\n")
    lines, doc = lists.flatten(), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    real = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines))) > 0
    coded = lines.dictionary_encode()
    key = doc[real] * (len(coded.dictionary) + 1) + np.asarray(coded.indices)[real]
    n = np.bincount(doc[real], minlength=len(rows))
    first = np.bincount(np.unique(key) // (len(coded.dictionary) + 1), minlength=len(rows))
    return n, n - first


def _dup_lines(rows: Rows) -> np.ndarray:
    rows.known["n_lines"], dup = _lines(rows)
    return dup


def _line_count(rows: Rows) -> np.ndarray:
    n, rows.known["n_dup_lines"] = _lines(rows)
    return n


def _top_word(rows: Rows) -> np.ndarray:
    """How often the most frequent word stands in the text."""
    ids, counts = rows.words()
    base = int(ids.max()) + 1 if len(ids) else 1
    key, n = np.unique(np.repeat(np.arange(len(counts)), counts) * base + ids, return_counts=True)
    out = np.zeros(len(counts), dtype=np.int64)
    np.maximum.at(out, key // base, n)
    return out


FEATURES: dict[str, Callable[[Rows], np.ndarray]] = {
    "n_words": lambda r: r.words()[1],
    "word_chars": lambda r: count_bytes(r, ~(IS_SPACE | INSIDE)),
    "n_symbols": lambda r: count_bytes(r, SYMBOL),
    "n_upper": lambda r: count_bytes(r, UPPER),
    "n_ascii_letters": lambda r: count_bytes(r, LETTER),
    "n_dup_lines": _dup_lines,
    "n_lines": _line_count,
    "n_repeat_words": _repeat_words,
    "n_top_word": _top_word,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` says which rows go; base rules are those of the contract."""
    name: str
    rejects: Callable[[Rows], np.ndarray]
    base: bool = False


RULES = (
    Rule("short", lambda r: r["n_words"] < 10, base=True),
    Rule("repeats", lambda r: 100 * r["n_repeat_words"] > 20 * r["n_words"], base=True),
    Rule("symbols", lambda r: 10 * r["n_symbols"] > r["n_words"]),
    Rule("line_copies", lambda r: 100 * r["n_dup_lines"] > 50 * r["n_lines"]),
    Rule("word_length", lambda r: (r["word_chars"] < 2 * r["n_words"]) | (r["word_chars"] > 20 * r["n_words"])),
    Rule("capitals", lambda r: 2 * r["n_upper"] > r["n_ascii_letters"]),
    Rule("one_word", lambda r: 10 * r["n_top_word"] > 3 * r["n_words"]),
)


def run_rules(rows: Rows, rules) -> np.ndarray:
    """Index of the first rule that rejects each row, -1 if none does; rejected rows are not shown to later rules."""
    verdict = np.full(len(rows), -1, dtype=np.int64)
    alive = np.arange(len(rows))
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        gone = np.asarray(rule.rejects(rows), dtype=bool)
        verdict[alive[gone]] = i
        alive, rows = alive[~gone], rows.take(~gone)
    return verdict


@dataclass(frozen=True)
class Prices:
    """Seconds a row of features and of the rules' own comparisons, what each asks for, and how often each set of
    verdicts was met: ``met["01..."]`` rows that the second rule rejects and the first does not."""
    seconds: dict[str, float]
    needs: dict[str, frozenset[str]]
    met: dict[str, int]

    def features(self, name: str) -> frozenset[str]:
        """All features below a rule or feature."""
        direct = self.needs.get(name, frozenset())
        return direct.union(*(self.features(n) for n in direct))


def measure(sample: DataFrame, rules=RULES, known: tuple[str, ...] = ()) -> Prices:
    """Prices on a sample; features named in ``known`` are computed before the cascade anyway and cost it nothing."""
    def body(part, texts):
        rows = Rows(texts)
        for name in known:
            rows[name]
        rows.spent, rows.needs = {}, {}
        hits = [np.asarray(rows.timed(f"rule {r.name}", lambda r=r: r.rejects(rows)), dtype=bool) for r in rules]
        out = [("seconds", n, took, len(texts), sorted(rows.needs[n])) for n, took in rows.spent.items()]
        if hits and len(texts):
            marks, n = np.unique(np.stack(hits, axis=1), axis=0, return_counts=True)
            out += [("met", "".join("01"[int(b)] for b in m), 0.0, k, []) for m, k in zip(marks, n.tolist())]
        kind, name, took, n, needs = zip(*out) if out else ([],) * 5
        return {"kind": pa.array(kind, type=pa.string()), "name": pa.array(name, type=pa.string()),
                "took": pa.array(took, type=pa.float64()), "n": pa.array(n, type=pa.int64()),
                "needs": pa.array(needs, type=pa.list_(pa.string()))}
    got = map_slices(sample, body, "kind string, name string, took double, n bigint, needs array<string>").groupBy(
        "kind", "name").agg(F.sum("took").alias("took"), F.sum("n").alias("n"),
                            F.array_distinct(F.flatten(F.collect_set("needs"))).alias("needs")).collect()
    timed = [r for r in got if r["kind"] == "seconds"]
    return Prices({r["name"]: r["took"] / max(r["n"], 1) for r in timed}, {r["name"]: frozenset(r["needs"]) for r in timed},
                  {r["name"]: r["n"] for r in got if r["kind"] == "met"})


def ordered(rules, prices: Prices) -> list[Rule]:
    """Rules by rejections per cost, each on what those before leave and without the features they have computed.

    Ties, and rules that reject nothing more, stand in the given order."""
    left, plan, have, met = list(enumerate(rules)), [], frozenset(), dict(prices.met)
    while left:
        def gain(entry):
            i, rule = entry
            parts = prices.features(f"rule {rule.name}") - have | {f"rule {rule.name}"}
            gone = sum(n for marks, n in met.items() if marks[i] == "1")
            return gone / max(sum(prices.seconds.get(p, 0.0) for p in parts), 1e-12)
        best = max(left, key=gain)
        left.remove(best)
        plan.append(best[1])
        have |= prices.features(f"rule {best[1].name}")
        met = {marks: n for marks, n in met.items() if marks[best[0]] == "0"}
    return plan


def sample_of(docs: DataFrame, wanted: int) -> DataFrame:
    total = docs.count()
    return docs.sample(min(1.0, wanted / total), seed=3) if total else docs


def quality_cascade(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, sample_rows: int = 2000,
                    counts: bool = False) -> DataFrame:
    """``(doc_id, kept, rejected_by)`` of every document, with the base counts and ``base_failed`` if ``counts``.

    About ``sample_rows`` rows are measured to order the rules. A null or empty text has no words and is too short.
    Repeated rows stay; an empty table gives none. With ``counts`` the base counts are taken of all rows, and only
    the other rules are saved their work."""
    frame = pick(docs, doc_id, text)
    plan = ordered(rules, measure(sample_of(frame, sample_rows), rules, BASE if counts else ()))

    def body(part, texts):
        rows = Rows(texts)
        base = {}
        if counts:
            base = {n: pa.array(rows[n]) for n in BASE}
            failed = np.zeros(len(texts), dtype=bool)
            for rule in rules:
                if rule.base:
                    failed |= np.asarray(rule.rejects(rows), dtype=bool)
            base["base_failed"] = failed
        verdict = run_rules(rows, plan)
        by = [plan[v].name if v >= 0 else None for v in verdict.tolist()]
        return {"doc_id": part.column("doc_id"), **base, "kept": verdict < 0, "rejected_by": pa.array(by, type=pa.string())}

    schema = "doc_id bigint, " + ("".join(f"{n} bigint, " for n in BASE) + "base_failed boolean, " if counts else "")
    return map_slices(frame, body, schema + "kept boolean, rejected_by string")
