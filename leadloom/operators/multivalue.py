"""Splitting several values packed into one field (problem 6).

A field is lexed into atoms (quoted spans, words, digit runs, separators). A segmentation reads the atoms as
a sequence of *values* (spans of atoms with a shape such as ``d3/d3-d4``) and *noise* atoms (separators,
labels, display names). Expectation-maximisation over the whole column learns how frequent each value shape
and each noise atom is; a Viterbi pass over the same lattice then picks the likeliest split. Quoted spans are
single atoms, so nothing inside quotes is ever cut.

The learned model only holds shapes, never values. It is estimated from every distinct shape of the column
with its count, in Spark. The frequencies of all shapes and atoms stay in a table that is joined with the lattices
that use them, so none is left out; only the two sums of the frequencies reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import cut, shuffled

_EMAIL = re.compile(r"[^\s@,;|/<>\"'():\[\]]+@[^\s@,;|/<>\"'():\[\]]+\.[^\s@,;|/<>\"'():\[\].]+\Z")
_EMAIL_LEX = re.compile(r"\"[^\"]*\"|[^\s,;|/<>\"'():\[\]，；、｜]+|\s+|.", re.S)
_PHONE_LEX = re.compile(r"\"[^\"]*\"|\d+|[^\W\d_]+\.?:?|[^\S\r\n]*[/,;|&][^\S\r\n]*|\s+|.", re.S)
_PHONE_SPAN = re.compile(r"(?:\+|\(\+?)?d\d+(?:[ ()/.\-]{0,3}d\d+)*\Z")
_PHONE_START = ("d", "+", "(")
_PHONE_GAP = re.compile(r"(?:\+|\(\+?)?\Z|.*\d[^\d]{0,3}\Z", re.S)  # what may still become a number


def _email_atoms(text: str) -> list[tuple[str, str]]:
    """(class, text) atoms of an e-mail field; class E is an address, Q a quoted span, QE a quoted address."""
    out: list[tuple[str, str]] = []
    for raw in _EMAIL_LEX.findall(text):
        if raw[0] == '"' and len(raw) > 1:
            inner = raw[1:-1].strip()
            out.append(("QE", inner) if _EMAIL.match(inner) else ("Q", raw))
        elif raw.isspace():
            out.append(("\n" if "\n" in raw or "\r" in raw else " ", raw))
        else:
            word = raw.strip(".")
            if _EMAIL.match(word):
                out.append(("E", word))
            else:
                out.append(("W" if len(raw) > 12 else raw.casefold(), raw))
    for i, (kind, raw) in enumerate(out):  # a quoted address in front of <...> is a display name
        if kind == "QE" and next((k for k, _ in out[i + 1 :] if k != " "), "") == "<":
            out[i] = ("Q", raw)
    return out


def _phone_atoms(text: str) -> list[tuple[str, str]]:
    """(class, text) atoms of a phone field; ``dN`` is a run of N digits, QP a quoted number."""
    out: list[tuple[str, str]] = []
    for raw in _PHONE_LEX.findall(text):
        if raw[0] == '"' and len(raw) > 1:
            inner = raw[1:-1].strip()
            shape = "".join(f"d{len(x)}" if x.isdigit() else x for x in re.findall(r"\d+|.", inner, re.S))
            ok = _PHONE_SPAN.match(shape) and 5 <= sum(map(str.isdigit, inner)) <= 16
            out.append(("QP", inner) if ok else ("Q", raw))
        elif raw.isdigit():
            out.append((f"d{len(raw)}", raw))
        elif raw.isspace():
            out.append(("\n" if "\n" in raw or "\r" in raw or "\t" in raw else " " if len(raw) < 3 else "   ", raw))
        else:
            out.append(("W" if len(raw) > 12 else raw.casefold(), raw))
    return out


def _value_spans(kind: str, classes: list[str]) -> dict[int, list[tuple[int, str]]]:
    """start -> [(end, shape)] of every admissible value span."""
    spans: dict[int, list[tuple[int, str]]] = {}
    for i, c in enumerate(classes):
        if c in ("E", "QE", "QP"):
            spans[i] = [(i + 1, c)]
        elif kind == "phone" and c[0] in _PHONE_START and (c[0] != "d" or c[1:].isdigit()):
            here, shape, digits = [], "", 0
            for j in range(i, len(classes)):
                cj = classes[j]
                if cj[0] == "d" and cj[1:].isdigit():
                    digits += int(cj[1:])
                elif cj not in ("+", "(", ")", "/", " / ", "-", ".", " ") or (cj == "+" and digits):
                    break
                shape += cj
                if digits > 16 or not _PHONE_GAP.match(shape):
                    break
                if cj[0] == "d" and digits >= 5 and _PHONE_SPAN.match(shape):
                    here.append((j + 1, shape))
            if here:
                spans[i] = here
    return spans


class SegmentModel:
    """Log-probabilities of value shapes and noise atoms with a length-based backoff.

    ``counts`` holds what one lattice uses, ``totals`` the sums over the whole column.
    """

    def __init__(self, counts: dict[tuple[str, str], float], totals: dict[str, float]):
        self.total = totals
        self.known = {key: math.log(c / (totals[key[0]] + 50.0)) for key, c in counts.items() if c > 1e-6}
        self.tie = math.log(0.5)

    def value(self, shape: str) -> float:
        base = self.known.get(("v", shape))
        rare = -3.0 - 0.9 * len(re.findall(r"d\d+|.", shape)) - math.log1p(self.total["v"])
        return (rare if base is None else max(base, rare)) + self.tie

    def noise(self, atom: str) -> float:
        base = self.known.get(("n", atom))
        # an unread number is far less likely than an unread separator or word
        digits = int(atom[1:]) if atom[0] == "d" and atom[1:].isdigit() else 0
        rare = -2.5 - 2.0 * digits - (8.0 if atom in ("E", "QE", "QP") else 0.0) - math.log1p(self.total["n"])
        if digits or atom in ("E", "QE", "QP"):
            return rare + self.tie
        return (rare if base is None else max(base, rare)) + self.tie


def _edges(kind: str, classes: list[str], model: SegmentModel) -> list[list[tuple[int, str, str, float]]]:
    spans = _value_spans(kind, classes)
    out = []
    for i, c in enumerate(classes):
        here = [(i + 1, "n", c, model.noise(c))]
        here += [(j, "v", shape, model.value(shape)) for j, shape in spans.get(i, ())]
        out.append(here)
    return out


def _logadd(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def expected_counts(kind: str, classes: list[str], model: SegmentModel) -> Iterator[tuple[str, str, float]]:
    """Posterior usage of every value shape and noise atom in one lattice (forward-backward)."""
    edges, n = _edges(kind, classes, model), len(classes)
    fwd = [0.0] + [-math.inf] * n
    for i in range(n):
        for j, _, _, lp in edges[i]:
            fwd[j] = _logadd(fwd[j], fwd[i] + lp)
    bwd = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        for j, _, _, lp in edges[i]:
            bwd[i] = _logadd(bwd[i], lp + bwd[j])
    for i in range(n):
        for j, what, shape, lp in edges[i]:
            p = math.exp(fwd[i] + lp + bwd[j] - fwd[n])
            if p > 1e-6:
                yield what, shape, p


def viterbi(kind: str, classes: list[str], model: SegmentModel) -> list[tuple[int, int]]:
    """(start, end) atom spans of the values in the likeliest segmentation."""
    edges, n = _edges(kind, classes, model), len(classes)
    best: list[tuple[float, int, bool]] = [(0.0, -1, False)] + [(-math.inf, -1, False)] * n
    for i in range(n):
        for j, what, _, lp in edges[i]:
            if (s := best[i][0] + lp) > best[j][0]:
                best[j] = (s, i, what == "v")
    out, at = [], n
    while at > 0:
        _, prev, is_value = best[at]
        if is_value:
            out.append((prev, at))
        at = prev
    return out[::-1]


_ATOMS = {"email": _email_atoms, "phone": _phone_atoms}


def _item(kind: str, text: str) -> str:
    if kind == "email":
        return text
    digits = "".join(c for c in text if c.isdigit())
    return "+" + digits if text.lstrip(" (").startswith("+") else digits


def _shapes(df: DataFrame, kind: str) -> DataFrame:
    """(shape, n) of a one-column frame ``value``; the same shape is counted once with its multiplicity."""

    def lex(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = pd.Series(["\x1f".join(c for c, _ in _ATOMS[kind](v)) for v in b["value"]], dtype="object")
            counts = seen.value_counts()
            yield pd.DataFrame({"shape": counts.index.astype("object"), "n": counts.to_numpy("float64")})

    return df.mapInPandas(lex, "shape string, n double").groupBy("shape").agg(F.sum("n").alias("n"))


def _used(shapes: DataFrame, kind: str) -> DataFrame:
    """(id, what, shape): the value shapes and noise atoms in the lattice of each shape, each once."""

    def use(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for at, shape in zip(b["id"], b["shape"], strict=True):
                classes = shape.split("\x1f")
                values = {s for here in _value_spans(kind, classes).values() for _, s in here}
                rows += [(at, "v", s) for s in values] + [(at, "n", c) for c in set(classes)]
            yield pd.DataFrame(rows, columns=["id", "what", "shape"])

    return shapes.select("id", "shape").mapInPandas(use, "id long, what string, shape string")


def _models(b: pd.DataFrame, totals: dict[str, float]) -> Iterator[SegmentModel]:
    """The model of each row of a batch, from its ``counts``."""
    for counts in b["counts"]:
        known = {} if counts is None else {(c["what"], c["shape"]): c["n"] for c in counts}
        yield SegmentModel(known, totals)


def learn(df: DataFrame, column: str, kind: str, iterations: int = 3) -> tuple[DataFrame, dict[str, float]]:
    """EM over every non-blank value of ``column``.

    Returns (id, shape, counts) of its distinct shapes, each with the frequencies its lattice uses, and their sums.
    """
    values = df.select(F.col(column).alias("value")).where(F.trim("value") != "")
    shapes = cut(_shapes(values, kind).select(F.xxhash64("shape").alias("id"), "shape", "n"))
    used = cut(_used(shapes, kind))
    weighted = shapes.withColumn("counts", F.lit(None).cast("array<struct<what:string,shape:string,n:double>>"))
    totals = {"v": 0.0, "n": 0.0}
    for _ in range(iterations):

        def e_step(batches: Iterable[pd.DataFrame], totals: dict[str, float] = totals) -> Iterator[pd.DataFrame]:
            for b in batches:
                acc: dict[tuple[str, str], float] = {}
                for shape, n, model in zip(b["shape"], b["n"], _models(b, totals), strict=True):
                    for what, s, p in expected_counts(kind, shape.split("\x1f"), model):
                        acc[what, s] = acc.get((what, s), 0.0) + p * n
                yield pd.DataFrame([(a, b, c) for (a, b), c in acc.items()], columns=["what", "shape", "n"])

        counts = cut(
            weighted.mapInPandas(e_step, "what string, shape string, n double")
            .groupBy("what", "shape").agg(F.sum("n").alias("n"))
        )
        totals = {"v": 0.0, "n": 0.0} | {r["what"]: r["n"] for r in counts.groupBy("what").agg(F.sum("n").alias("n")).collect()}
        own = (
            used.join(shuffled(counts), ["what", "shape"])
            .groupBy("id").agg(F.collect_list(F.struct("what", "shape", "n")).alias("counts"))
        )
        weighted = cut(shapes.join(shuffled(own), "id", "left").select("id", "shape", "n", "counts"))
    return weighted, totals


def _decoded(weighted: DataFrame, totals: dict[str, float], kind: str) -> DataFrame:
    """(id, spans): first atom and end of every value in the likeliest split of each shape."""

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [
                [x for span in viterbi(kind, shape.split("\x1f"), model) for x in span]
                for shape, model in zip(b["shape"], _models(b, totals), strict=True)
            ]
            yield pd.DataFrame({"id": b["id"], "spans": spans})

    return weighted.mapInPandas(decode, "id long, spans array<int>")


def _shape_of(kind: str):
    """Vectorised shape of a field."""

    def shape(values: pd.Series) -> pd.Series:
        return pd.Series(["\x1f".join(c for c, _ in _ATOMS[kind](v)) for v in values], dtype="object")

    return shape


def _cutter(kind: str):
    """Vectorised cut of a field at the spans of its shape."""

    def split(values: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for v, s in zip(values, spans, strict=True):
            atoms = [t for _, t in _ATOMS[kind](v)]
            out.append([_item(kind, "".join(atoms[a:b])) for a, b in zip(s[::2], s[1::2], strict=True)])
        return pd.Series(out, dtype="object")

    return split


def split_packed(df: DataFrame, id_col: str, fields: dict[str, str], iterations: int = 3) -> DataFrame:
    """(<id_col>, field_name, item_no, item, n_items), one row per value, numbered from 1 in written order.

    ``fields`` maps a column to its kind, ``email`` or ``phone``. NULL, blank and value-free fields give no
    row; repeats are kept; a field of any length is read whole; an empty table gives an empty result.
    """
    parts = []
    for column, kind in fields.items():
        spans = _decoded(*learn(df, column, kind, iterations), kind)
        shape, udf = F.pandas_udf(_shape_of(kind), "string"), F.pandas_udf(_cutter(kind), "array<string>")
        parts.append(
            df.where(F.trim(F.col(column)) != "")
            .select(F.col(id_col), F.col(column).alias("_value"), F.xxhash64(shape(F.col(column))).alias("_shape"))
            .join(shuffled(spans.withColumnRenamed("id", "_shape")), "_shape")
            .select(F.col(id_col), udf("_value", "spans").alias("items"))
            .select(
                id_col,
                F.lit(column).alias("field_name"),
                F.size("items").alias("n_items"),
                F.posexplode("items").alias("pos", "item"),
            )
            .select(id_col, "field_name", (F.col("pos") + 1).cast("int").alias("item_no"), "item", "n_items")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
