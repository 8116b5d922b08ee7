"""Many searches at once: one scan of texts and one of vectors for all of them.

An evaluation asks thousands of cases of the same index. The scan of texts finds
all cases' terms with one automaton and keeps, of each row, what of them it has.
Then every task holds its rows against all cases and keeps each case's best so
many; those of all tasks are ranked by case. Vectors are multiplied with all
encoded queries, block by block. Rankings are those of ``search.candidates``, case by case.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_fold, supports_trigrams
from ..session import shared_path
from . import evaluation as ev
from . import search as s

#: Cases that are asked at once, at most; they are sent to all tasks.
MOST_CASES = 20_000
#: Rows, and vectors, that are held against all cases at a time.
ROWS, VECTORS = 1000, 512
#: Products of blocks may differ from sums in order by less than this; what is so near to the last place is summed again.
MARGIN = 1e-9

_META = "id string, kind string, status string, session string, agent string, subjects array<string>, types array<string>, timestamp_ns long"
_RANKED = "case_id string, id string, score double, timestamp_ns long"


class _Asked:
    """Cases as arrays, without what Spark needs to know of them."""

    def __init__(self, cases: dict[str, s.Options]):
        self.cases = {k: s.validate(o) for k, o in cases.items()}
        if len(cases) > MOST_CASES:
            raise ValueError(f"{len(cases)} cases, more than {MOST_CASES}")
        if any(o.last for o in self.cases.values()):
            raise ValueError("the last so many turns are not a ranking")
        fold = str.maketrans(UPPER, LOWER)
        self.by_gram = {k: [t.lower() for t in o.terms] for k, o in self.cases.items() if supports_trigrams(o.terms)}
        self.by_part = {k: [t.translate(fold) for t in o.terms] for k, o in self.cases.items() if o.terms and k not in self.by_gram}
        self.terms = sorted({t for ts in self.by_gram.values() for t in ts})
        self.parts = sorted({t for ts in self.by_part.values() for t in ts})
        self.needs_all = any(not o.terms for o in self.cases.values())

    def kinds(self) -> list[str]:
        return sorted({o.kind for o in self.cases.values()})


class _Filter:
    """Rows that options' filters leave, as masks; each is made once for a block of rows."""

    def __init__(self, pdf: pd.DataFrame):
        self.pdf, self.masks = pdf, {}

    def _mask(self, key: tuple, make) -> np.ndarray:
        if key not in self.masks:
            self.masks[key] = make()
        return self.masks[key]

    def _is(self, column: str, *values: str) -> np.ndarray:
        return self._mask((column, *values), lambda: self.pdf[column].isin(values).to_numpy())

    def _has(self, column: str, value: str) -> np.ndarray:
        return self._mask((column, "has", value), lambda: np.array([v is not None and value in v for v in self.pdf[column]], bool))

    def eligible(self, o: s.Options) -> np.ndarray:
        out = self._is("kind", o.kind).copy()
        if o.kind == "knowledge":
            out &= self._is("status", *s.visible_statuses(o.include_pending, o.include_retired))
        if o.subject:
            out &= self._has("subjects", o.subject)
        if o.type or o.template:
            out &= self._has("types", o.type or o.template)
        for name in ("session", "agent"):
            if getattr(o, name):
                out &= self._is(name, getattr(o, name))
        ts = self.pdf["timestamp_ns"].to_numpy()
        if o.since_ns is not None:
            out &= ts >= o.since_ns
        if o.until_ns is not None:
            out &= ts <= o.until_ns
        return out


class _Best:
    """A task's best rows of each case: by score, then time, both descending, then id."""

    def __init__(self, depth: dict[str, int]):
        self.depth, self.rows = depth, {k: [] for k in depth}

    def add(self, case: str, ids: np.ndarray, score: np.ndarray, ts: np.ndarray) -> None:
        own, depth = self.rows[case], self.depth[case]
        if len(own) >= depth:
            keep = score >= -own[-1][0]
            ids, score, ts = ids[keep], score[keep], ts[keep]
        if len(ids) > depth:
            keep = score >= np.partition(score, len(score) - depth)[len(score) - depth]
            ids, score, ts = ids[keep], score[keep], ts[keep]
        if len(ids):
            self.rows[case] = sorted([*own, *zip((-score).tolist(), (-ts).tolist(), ids.tolist(), strict=True)])[:depth]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame([(k, i, -a, -t) for k, own in self.rows.items() for a, t, i in own], columns=["case_id", "id", "score", "timestamp_ns"])


def _ranked(best: DataFrame, depth: dict[str, int], scored: bool = True) -> DataFrame:
    """(case_id, id, rank, score) of the best of all tasks, to each case's depth."""
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), F.desc("timestamp_ns"), F.asc("id"))
    out = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(depth.values(), default=0))
    # Cases have a few depths at most; those of the smaller ones are cut here.
    by_depth: dict[int, list[str]] = {}
    for k, n in depth.items():
        by_depth.setdefault(n, []).append(k)
    for n, own in by_depth.items():
        if n < max(by_depth):
            out = out.where(~F.col("case_id").isin(own) | (F.col("rank") <= n))
    return out.select("case_id", "id", "rank", "score" if scored else F.lit(None).cast("double").alias("score"))


def _meta(index: DataFrame) -> list:
    return [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _META.split(", ")]


def _scan(index: DataFrame, asked: _Asked) -> tuple[DataFrame, dict]:
    """Rows with the terms that they have (numbers and frequencies) and those parts, and statistics of the whole index; one scan of all texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    length = F.greatest(F.length(text("summary")) - 2, F.lit(0)) + F.greatest(F.length(text("searchable")) - 2, F.lit(0))
    wide = index.select(*_meta(index), length.cast("long").alias("_len"), F.lower(text("summary")).alias("_a"), F.lower(text("searchable")).alias("_b"), (ascii_fold(text("searchable")) if asked.parts else F.lit("")).alias("_c"))
    seen = Observation()
    wide = wide.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"))
    terms, parts, everything = asked.terms, asked.parts, asked.needs_all

    def automaton(words: list[str]):
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, w in enumerate(words):
            found.add_word(w, k)
        found.make_automaton()
        return found

    def find(it):
        by_term, by_part = (automaton(w) if w else None for w in (terms, parts))
        for pdf in it:
            out, keep = [], []
            for a, b, c in zip(pdf["_a"], pdf["_b"], pdf["_c"], strict=True):
                n = Counter(k for text in (a, b) for _, k in by_term.iter(text)) if by_term else {}
                own = sorted({k for _, k in by_part.iter(c)}) if by_part else []
                keep.append(everything or bool(n) or bool(own))
                out.append(([*n], [*n.values()], own))
            rows = pdf.drop(columns=["_a", "_b", "_c"]).assign(terms=[x[0] for x in out], tfs=[x[1] for x in out], parts=[x[2] for x in out])
            yield rows[np.array(keep, bool)]

    found = wide.mapInPandas(find, f"{_META}, _len long, terms array<int>, tfs array<int>, parts array<int>")
    path = shared_path(index.sparkSession, "batch-matches")
    found.write.parquet(path)
    return index.sparkSession.read.schema(found.schema).parquet(path), seen.get


def text_rankings(index: DataFrame, cases: dict[str, s.Options], depth: dict[str, int]) -> DataFrame:
    """(case_id, id, rank, score): each case's ``search.text_branch`` to its depth; without keywords the newest first."""
    asked, spark = _Asked(cases), index.sparkSession
    rows, totals = _scan(index, asked)
    df = {r["t"]: r["n"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()} if asked.terms else {}
    idf = np.array([np.log((totals["n"] - df.get(k, 0) + 0.5) / (df.get(k, 0) + 0.5)) for k in range(len(asked.terms))])
    idf, mean = np.where(idf <= 0, s.LEAST_IDF, idf), totals["mean"]
    term, part = ({t: k for k, t in enumerate(words)} for words in (asked.terms, asked.parts))
    by_gram = {k: np.array([term[t] for t in ts]) for k, ts in asked.by_gram.items()}
    by_part = {k: np.array([part[t] for t in ts]) for k, ts in asked.by_part.items()}
    sent = spark.sparkContext.broadcast((asked.cases, by_gram, by_part, idf, mean, depth, len(term), len(part)))

    def hold(it):
        cases, by_gram, by_part, idf, mean, depth, n_terms, n_parts = sent.value
        best = _Best(depth)
        for whole in it:
            for lo in range(0, len(whole), ROWS):
                pdf = whole.iloc[lo : lo + ROWS].reset_index(drop=True)
                tf, has = np.zeros((n_terms, len(pdf)), np.int32), np.zeros((n_parts, len(pdf)), bool)
                for i, (k, n, p) in enumerate(zip(pdf["terms"], pdf["tfs"], pdf["parts"], strict=True)):
                    tf[k, i] = n
                    has[p, i] = True
                ids, ts, wide = pdf["id"].to_numpy(object), pdf["timestamp_ns"].to_numpy(np.int64), _Filter(pdf)
                some = (tf > 0).any(1)
                norm = s.K1 * (1 - s.B + s.B * pdf["_len"].to_numpy() / mean) if mean else np.zeros(len(pdf))
                for case, o in cases.items():
                    own = by_gram.get(case)
                    if own is not None:
                        if not some[own].all():
                            continue
                        at = np.flatnonzero((tf[own] > 0).all(0) & wide.eligible(o))
                        score = np.zeros(len(at))
                        for t in own:
                            score = score + idf[t] * tf[t, at] * (s.K1 + 1) / (tf[t, at] + norm[at])
                    else:
                        at = np.flatnonzero((has[by_part[case]].all(0) if case in by_part else True) & wide.eligible(o))
                        score = np.zeros(len(at))
                    if len(at):
                        best.add(case, ids[at], score, ts[at])
        yield best.frame()

    out = _ranked(rows.mapInPandas(hold, _RANKED), depth)
    unscored = [k for k in cases if k not in asked.by_gram]
    return out.withColumn("score", F.when(~F.col("case_id").isin(unscored), F.col("score"))) if unscored else out


def vector_rankings(index: DataFrame, vectors: DataFrame, cases: dict[str, s.Options], depth: dict[str, int]) -> DataFrame:
    """(case_id, id, rank, score): each case's ``search.vector_branch`` to its depth."""
    asked = _Asked(cases)
    query = np.array([o.query_vector for o in asked.cases.values()], np.float64).reshape(len(cases), -1)
    own = vectors.where(F.col("kind").isin(asked.kinds())).select("id", "kind", "embedding").join(index.select(*_meta(index)), ["id", "kind"])
    sent = index.sparkSession.sparkContext.broadcast((asked.cases, query, depth))

    def hold(it):
        cases, query, depth = sent.value
        best = _Best(depth)
        for whole in it:
            for lo in range(0, len(whole), VECTORS):
                pdf = whole.iloc[lo : lo + VECTORS].reset_index(drop=True)
                v, wide = np.stack(pdf["embedding"].to_list()).astype(np.float64), _Filter(pdf)
                ids, about = pdf["id"].to_numpy(object), v @ query.T
                for c, (case, o) in enumerate(cases.items()):
                    at = np.flatnonzero(wide.eligible(o))
                    n, near = depth[case], about[at, c]
                    if len(at) > n:
                        at = at[near >= np.partition(near, len(near) - n)[len(near) - n] - MARGIN]
                    if len(at):
                        best.add(case, ids[at], _in_order(v[at], query[c]), np.zeros(len(at), np.int64))
        yield best.frame()

    return _ranked(own.mapInPandas(hold, _RANKED), depth)


def _in_order(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products summed from the first component to the last, as ``vectors.dot`` does."""
    out = np.zeros(len(v))
    for k in range(v.shape[1]):
        out = out + v[:, k] * q[k]
    return out


def fused(branches: dict[str, DataFrame], depth: dict[str, int]) -> DataFrame:
    """(case_id, id, rank, score): reciprocal rank fusion of rankings, case by case."""
    parts = None
    for b in branches.values():
        own = b.select("case_id", "id", (1.0 / (s.FUSION_CONSTANT + F.col("rank"))).alias("score"))
        parts = own if parts is None else parts.unionByName(own)
    sums = parts.groupBy("case_id", "id").agg(F.sum("score").alias("score")).withColumn("timestamp_ns", F.lit(0).cast("long"))
    return _ranked(sums, depth)


def rankings(index: DataFrame, vectors: DataFrame | None, cases: dict[str, s.Options]) -> DataFrame:
    """(case_id, id, rank): what ``search.candidates`` gives for each case by itself, to one more than its limit."""
    cases = {k: s.validate(o) for k, o in cases.items()}
    by_vector = {k: o for k, o in cases.items() if o.terms and o.mode == "vector"}
    hybrid = {k: o for k, o in cases.items() if o.terms and o.mode == "hybrid" and o.query_vector is not None and vectors is not None}
    by_text = {k: o for k, o in cases.items() if k not in by_vector and k not in hybrid}
    out = []
    limit = lambda own: {k: o.limit + 1 for k, o in own.items()}
    deep = {k: s.depth_of(o) for k, o in hybrid.items()}
    if by_text or hybrid:
        text = text_rankings(index, by_text | hybrid, limit(by_text) | deep)
        text = _staged(text) if hybrid else text
        if by_text:
            out.append(text.where(F.col("case_id").isin([*by_text])) if hybrid else text)
    if by_vector or hybrid:
        near = vector_rankings(index, vectors, by_vector | hybrid, limit(by_vector) | deep)
        near = _staged(near) if hybrid else near
        if by_vector:
            out.append(near.where(F.col("case_id").isin([*by_vector])) if hybrid else near)
    if hybrid:
        own = lambda b, others: b.where(~F.col("case_id").isin([*others])) if others else b
        out.append(fused({"text": own(text, by_text), "vector": own(near, by_vector)}, limit(hybrid)))
    if not out:
        return index.sparkSession.createDataFrame([], "case_id string, id string, rank int")
    whole = out[0].select("case_id", "id", "rank")
    for o in out[1:]:
        whole = whole.unionByName(o.select("case_id", "id", "rank"))
    return whole


def _staged(rows: DataFrame) -> DataFrame:
    """Rankings as a table: a few rows a case, which are asked again, and whose union claims no partitioning."""
    path = shared_path(rows.sparkSession, "batch-rankings")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def evaluate(index: DataFrame, vectors: DataFrame, cases: dict[str, s.Options], qrels: DataFrame, depth: int = s.LEAST_DEPTH) -> DataFrame:
    """A report: mode (text, vector, hybrid), cases, and the means of recall, nDCG and MRR over all cases. Each branch is ranked once, to ``depth``; qrels (case_id, id, grade) of other cases don't count."""
    depths = dict.fromkeys(cases, depth)
    text, near = (_staged(b) for b in (text_rankings(index, cases, depths), vector_rankings(index, vectors, cases, depths)))
    known = qrels.join(F.broadcast(index.sparkSession.createDataFrame([(k,) for k in cases], "case_id string")), "case_id", "left_semi")
    out = None
    for mode, ranking in (("text", text), ("vector", near), ("hybrid", fused({"text": text, "vector": near}, depths))):
        metrics = ev.case_metrics(ranking.select("case_id", "id", "rank"), known)
        row = metrics.agg(F.count(F.lit(1)).alias("cases"), *(F.avg(c).alias(c) for c in metrics.columns if c not in ("case_id", "relevant"))).withColumn("mode", F.lit(mode))
        out = row if out is None else out.unionByName(row)
    return out
