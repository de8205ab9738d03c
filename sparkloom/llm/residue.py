"""Template residue, filler, error pages and script notices in texts.

Character n-gram models are fitted for each kind of residue, for page furniture and for natural
prose. Along a text, windows in which the likelihood ratio of a kind against prose is high localise
that kind; the windows' coverage decides: filler and unfilled fields make a case wherever they
cover enough, messages only if hardly any prose is left outside all windows.

Labelled phrases only start the models. Prose is counted in the inner part of all long texts,
furniture in their first and last characters, and how the texts themselves put a kind of residue is
learnt around the windows that the labelled phrases make sure of, over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import residue_examples as examples
from sparkloom.llm.common import durable, table

KINDS = ["filler", "error", "script", "chrome"]
LEARNT = 3  # the first kinds, whose wording is learnt where they are found
ORDERS = (3, 4, 5)
BITS = 17
WINDOW = 20
FIELD_WINDOW = 4
#: Relative frequency added to both sides of a ratio: n-grams rare in both say nothing.
SMOOTH = 2e-4
#: Texts of at least so many characters are mostly prose but for their first and last characters (title,
#: menu, notices, footer), from which furniture is learnt.
MIN_PROSE, HEAD, TAIL = 500, 150, 250
#: Window mean from which the wording of a labelled kind is learnt from the texts, and how far around.
SURE, AROUND = 0.7, 24
#: Ratios are whole numbers of this unit, so that sums are exact.
UNIT = 1 / 1024
#: Histograms of window means from 0 on, for the bounds: bins of each kind and by 1 of the mean.
BINS, BINS_BY_1 = 1 << 14, 1 << 12
#: Slots that are summed over tasks as one row.
BLOCK = 1 << 14
#: Least characters covered by filler, in all and by character of prose (less is talk about filler).
FILLER_COVER, FILLER_RATIO = 30, 0.06
#: Least characters covered by messages; the most prose beside them, in all and by covered character.
MESSAGE_COVER, PROSE_LEFT, PROSE_RATIO = 20, 100, 2.2
#: Fields count if there is less prose than this for each (a text about templates quotes one).
FIELD_PROSE = 400
#: Added to page furniture when kinds are compared: it is everywhere, messages are not.
FURNITURE = 0.3

_DIGITS = re.compile(r"\d+")
_PATH = re.compile(r"(?<![\w<&/])/[\w.\-/]*[\w/](?:\?[\w=&]*)?")
_HOST = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|edu|gov|info|test|example|invalid|[a-z]{2})\b")
_HEX = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{6,}\b")
_BROKEN = re.compile(r"[ÃÂÐÑãå][\u0080-\u00ff\u2000-\u22ff\u0152-\u0192]|[РСГВг][\u0080-\u00bf\u0402-\u040f\u0452-\u045f\u2010-\u2122]")
_QUOTE = re.compile(r"“[^”]{12,}”|«[^»]{20,}»|„[^“”]{12,}[“”]")
_UNDEFINED, _OBJECT = re.compile("undefined", re.I), re.compile("object object", re.I)
_WORD, _LETTER = re.compile(r"[^\W\d_](?:[^\W\d_]|_(?=[^\W\d_]))+"), re.compile(r"[^\W\d_]")
_MARKS = str.maketrans({"\x01": "[[w]]", "\x02": "w", "\x03": "w"})


def repaired(text: str) -> str:
    """UTF-8 that was decoded as a single-byte charset, decoded again; line by line, else as it is."""
    if text.isascii() or not _BROKEN.search(text):
        return text
    out = []
    for line in text.split("\n"):
        for charset in ("cp1252", "cp1251", "latin-1"):
            try:
                line = line.encode(charset).decode("utf-8")
                break
            except UnicodeError:
                pass
        out.append(line)
    return "\n".join(out)


def normal(text: str) -> str:
    """Lower case, numbers as 0, paths as /p, hosts and long hexadecimal numbers removed."""
    t = repaired(text).lower()
    t = _HEX.sub("0a0b0c0d", t)
    t = " ".join(_HOST.sub("", w) if "." in w[:-1] else w for w in t.split())  # hosts have no blanks
    if "/" in t:
        t = _PATH.sub("/p", t)
    return " ".join(_DIGITS.sub("0", t).split())


def shape(text: str) -> str:
    """Words as w (a single letter as x), numbers as 0; what stays is how they are bracketed."""
    t = text.replace("&lt;", "<").replace("&gt;", ">")
    t = _OBJECT.sub("\x02", _UNDEFINED.sub("\x01", t))
    t = _LETTER.sub("x", _WORD.sub("\x03", t)).translate(_MARKS)
    return " ".join(_DIGITS.sub("0", t).split())


def codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by ``pad`` zeros; start of each)."""
    gap = "\0" * pad
    joined = np.frombuffer("".join([t + gap for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) + pad for t in texts], np.int64)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def slots(c: np.ndarray) -> list[np.ndarray]:
    """By order: slot of the n-gram that starts at each position (shorter at the end of the array)."""
    c = np.concatenate([c.astype(np.uint32), np.zeros(max(ORDERS), np.uint32)])
    n = len(c) - max(ORDERS)
    h, out = np.zeros(n, np.uint32), []
    for k in range(max(ORDERS)):
        h = h * np.uint32(0x9E3779B1) + c[k : k + n]
        if k + 1 in ORDERS:
            out.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def gram_counts(c: np.ndarray, where: list[np.ndarray]) -> np.ndarray:
    """int[part, order, slot]: n-grams that start at the positions of each part."""
    out = np.zeros((len(where), len(ORDERS), 1 << BITS), np.int64)
    for i, s in enumerate(slots(c)):
        for k, at in enumerate(where):
            out[k, i] = np.bincount(s[at], minlength=1 << BITS)
    return out


def lines(block: str) -> list[str]:
    return [x.strip() for x in block.strip().splitlines()]


def covered(hit: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the windows that hit."""
    edge = np.zeros(n + 1, np.int32)
    edge[: len(hit)] += hit
    edge[width : width + len(hit)] -= hit
    return np.cumsum(edge[:-1]) > 0


def inner(start: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """bool[n]: the inner part of the long texts, and their first and last characters."""
    long = sizes >= MIN_PROSE
    at = np.zeros(n + 1, np.int32)
    for place, step in ((start, 1), (start + HEAD, 1), (start + sizes - TAIL, -1), (start + sizes, -1)):
        np.add.at(at, place[long], step)
    level = np.cumsum(at[:-1])  # 1 at the edges, 2 inside
    return level == 2, level == 1


@dataclass
class ResidueModel:
    """Log ratios against prose (in UNITs) by order, slot and kind (KINDS together, fields apart),
    and the least window mean by kind; of fixed size."""

    kinds: np.ndarray
    field: np.ndarray
    bounds: dict[str, float]


def window_means(ratios: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    """[kind, window]: mean ratio of the n-grams that start in each window."""
    k = ratios.shape[2]
    wide = {1: np.int16, 4: np.int64}[k]  # the ratios of a slot are taken as one number
    total = np.zeros((len(c), k), np.int16)
    for table, s in zip(ratios, slots(c)):
        total += table.view(wide).ravel()[s].view(np.int16).reshape(-1, k)
    total[c == 0] = 0
    sums = np.zeros((k, len(c) + 1), np.int32)
    np.cumsum(total.T, axis=1, dtype=np.int32, out=sums[:, 1:])
    return (sums[:, width:] - sums[:, :-width]) * np.float32(UNIT / len(ORDERS) / width)


def counts(plain: list[str], forms: list[str]) -> np.ndarray:
    """int[3, order, slot]: n-grams of prose, of the edges of pages, and of shapes of prose; sums over
    parts are those of the whole."""
    c, start = codes(plain, max(ORDERS))
    sizes = np.array([len(t) for t in plain], np.int64)
    prose = gram_counts(c, [*inner(start[:-1], sizes, len(c))])
    c, _ = codes([f for f, n in zip(forms, sizes) if n >= MIN_PROSE], max(ORDERS))
    return np.concatenate([prose, gram_counts(c, [c != 0])])


def spread(model: ResidueModel, plain: list[str], forms: list[str]) -> np.ndarray:
    """int[kind, bin]: how many windows that begin in prose have which mean, KINDS and fields; sums
    over parts are those of the whole."""
    out = np.zeros((len(KINDS) + 1, BINS), np.int64)
    sizes = np.array([len(t) for t in plain], np.int64)
    c, start = codes(plain, WINDOW)
    means = window_means(model.kinds, c, WINDOW)
    prose, _ = inner(start[:-1], sizes, len(c))
    shapes, _ = codes([f for f, n in zip(forms, sizes) if n >= MIN_PROSE], FIELD_WINDOW)
    for at, m, where in ((0, means, prose), (len(KINDS), window_means(model.field, shapes, FIELD_WINDOW), shapes != 0)):
        for i, x in enumerate(m):
            x = x[where[: len(x)]]
            out[at + i] = np.bincount(np.clip(x * BINS_BY_1, 0, BINS - 1).astype(np.int64), minlength=BINS)
    return out


def _shares(n: np.ndarray) -> np.ndarray:
    return n / np.maximum(1, n.sum(axis=-1, keepdims=True))


def contrasted(n: np.ndarray, learnt: np.ndarray | None = None) -> ResidueModel:
    """The ratios of labelled phrases, and of what was ``learnt`` of them, against prose of these
    ``counts``; no bounds yet."""
    base = _shares(n) + SMOOTH

    def rates(texts: list[str]) -> np.ndarray:
        c, _ = codes(texts, max(ORDERS))
        return _shares(gram_counts(c, [c != 0]))[0]

    seeds = np.stack([rates([normal(x) for x in lines(getattr(examples, k.upper()))]) for k in KINDS])
    more = np.zeros_like(seeds) if learnt is None else np.concatenate([_shares(learnt), np.zeros_like(seeds[LEARNT:])])
    more[LEARNT:] = _shares(n[1])
    known = more.any(axis=(1, 2))[:, None, None]
    kinds = np.log((np.where(known, (seeds + more) / 2, seeds) + SMOOTH) / base[0])
    field = np.log((rates([shape(x) for x in lines(examples.TEMPLATE)]) + SMOOTH) / base[2])
    whole = lambda x: np.ascontiguousarray(np.rint(np.clip(x, -8, 8) / UNIT).astype(np.int16))
    return ResidueModel(whole(np.moveaxis(kinds, 0, 2)), whole(field[:, :, None]), {**dict.fromkeys(KINDS, 0.8), "field": 2.5})


def bounded(model: ResidueModel, n: np.ndarray) -> ResidueModel:
    """The model with bounds from the ``spread`` of prose."""
    for kind, h in zip([*KINDS, "field"], n):
        if total := h.sum():
            low, high = {"field": (1.2, 2.5), "filler": (0.6, 1.0)}.get(kind, (0.35, 0.8))
            at = np.searchsorted(np.cumsum(h), (0.9 if kind == "chrome" else 0.999) * total) + 0.5
            model.bounds[kind] = float(np.clip(at / BINS_BY_1, low, high))
    return model


def _hits(model: ResidueModel, means: np.ndarray, least: dict[str, float]) -> list[np.ndarray]:
    """Windows by kind; each speaks for its likeliest kind only (furniture is everywhere, so it has a start)."""
    lift = FURNITURE * (np.arange(len(KINDS)) == KINDS.index("chrome")).astype(np.float32)
    top = (means + lift[:, None]).max(axis=0)
    return [(m + x >= top) & (m >= least[k]) for k, m, x in zip(KINDS, means, lift)]


def wording(model: ResidueModel, plain: list[str], forms: list[str]) -> np.ndarray:
    """int[kind, order, slot]: n-grams in and around the windows that surely are of the first kinds, of
    texts in which they cover as much (messages: little else than furniture is beside them) as a case needs."""
    c, start = codes(plain, WINDOW)
    means = window_means(model.kinds, c, WINDOW)
    hits = _hits(model, means, {k: SURE for k in KINDS[:LEARNT]} | {"chrome": model.bounds["chrome"]})
    at = [covered(h, len(c), WINDOW) & (c != 0) for h in hits]
    rest = _by_text((c != 0) & (c != 32) & ~np.logical_or.reduce(at), start)
    parts = []
    for k, h, a in zip(KINDS[:LEARNT], hits, at):
        n = _by_text(a, start)
        placed = (n >= FILLER_COVER) & (n >= FILLER_RATIO * rest) if k == "filler" else (n >= MESSAGE_COVER) & (rest <= 2 * PROSE_LEFT)
        edge = np.zeros(len(c) + 2 * AROUND + WINDOW + 1, np.int32)
        edge[: len(h)] += h
        edge[2 * AROUND + WINDOW : 2 * AROUND + WINDOW + len(h)] -= h
        near = np.cumsum(edge)[AROUND : AROUND + len(c)] > 0
        parts.append(near & (c != 0) & ~at[KINDS.index("chrome")] & np.repeat(placed, np.diff(start)))
    return gram_counts(c, parts)


def _by_text(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[start[1:]] - total[start[:-1]]


def fit(texts: list[str]) -> ResidueModel:
    """``fit_corpus`` of a few texts, in this process."""
    plain, forms = [*map(normal, texts)], [*map(shape, texts)]
    n = counts(plain, forms)
    model = contrasted(n, wording(contrasted(n), plain, forms))
    return bounded(model, spread(model, plain, forms))


MEASURES = ["filler_chars", "fields", "error_chars", "script_chars", "prose_chars"]


def measure(model: ResidueModel, texts: list[str]) -> np.ndarray:
    """int[n, 5]: MEASURES of each text. A wide (CJK) character of prose counts as three."""
    return measured(model, [*map(normal, texts)], [*map(shape, texts)])


def measured(model: ResidueModel, plain: list[str], forms: list[str]) -> np.ndarray:
    """``measure`` of texts of which there are the normal form and the shape."""
    c, start = codes(plain, WINDOW)
    hits = _hits(model, window_means(model.kinds, c, WINDOW), model.bounds)
    at = {k: covered(h, len(c), WINDOW) & (c != 0) for k, h in zip(KINDS, hits)}
    for i, t in enumerate(plain):  # words quoted in prose are talked about
        for m in _QUOTE.finditer(t):
            at["filler"][start[i] + m.start() : start[i] + m.end()] = False
    letter = ((c >= 97) & (c <= 122)) | (c > 191)
    rest = letter & ~(at["filler"] | at["error"] | at["script"] | at["chrome"])
    weight = np.where(rest, np.where((c >= 0x3040) & (c <= 0x9FFF), 3, 1), 0)
    fc, fstart = codes(forms, FIELD_WINDOW)
    on = covered(window_means(model.field, fc, FIELD_WINDOW)[0] >= model.bounds["field"], len(fc), FIELD_WINDOW) & (fc != 0)
    begins = on & ~np.concatenate([[False], on[:-1]])
    by = [(at["filler"], start), (begins, fstart), (at["error"], start), (at["script"], start), (weight, start)]
    return np.stack([_by_text(*x) for x in by], axis=1).astype(np.int64)


def cases(m: np.ndarray) -> np.ndarray:
    filler, fields, error, script, prose = m.T
    message = np.maximum(error, script)
    alone = (message >= MESSAGE_COVER) & (prose <= PROSE_LEFT) & (prose <= PROSE_RATIO * message)
    placed = (filler >= FILLER_COVER) & (filler >= FILLER_RATIO * prose)
    return placed | (prose < FIELD_PROSE * fields) | alone


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield b.slice(i, 256)


def blocks(total: np.ndarray) -> dict[int, np.ndarray]:
    return {i: x for i, x in enumerate(total.reshape(-1, BLOCK)) if x.any()}


def _sent(parts: dict[int, np.ndarray]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for i, x in parts.items():
        yield pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())


def added(partial: DataFrame, like: tuple[int, ...]) -> np.ndarray:
    """The sum of what tasks sent as blocks (block, n), added block by block; the driver gets one
    array of this shape, however large the table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(x, np.int64)
        for x in _sent(total):
            yield pa.RecordBatch.from_arrays([*x], names=["block", "n"])

    out = np.zeros((int(np.prod(like)) // BLOCK, BLOCK), np.int64)
    for r in partial.select("block", "n").repartition("block").mapInArrow(add, "block int, n binary").collect():
        out[r["block"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(like)


def summed(forms: DataFrame, count: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
    """The sum of ``count`` over all rows (plain, form)."""
    like = count([""], [""]).shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(like, np.int64)
        for b in slices(batches):
            total += count(b.column(0).to_pylist(), b.column(1).to_pylist())
        for x in _sent(blocks(total)):
            yield pa.RecordBatch.from_arrays([*x], names=["block", "n"])

    return added(forms.select("plain", "form").mapInArrow(run, "block int, n binary"), like)


#: Two hashes of a text, by which its copies find what was measured once.
COPY = ["xxhash64(text) AS h1", "hash(text) AS h2"]


def fit_corpus(df: DataFrame, text: str = "text") -> tuple[ResidueModel, DataFrame]:
    """The model fitted on all different texts, in whatever order they lie, and their forms
    (h1, h2, plain, form), as a written table.

    Three passes: forms and counts, wording, spread; the tasks' sums have a fixed size.
    """
    sent = df.sparkSession.sparkContext.broadcast
    schema = "h1 long, h2 int, plain string, form string, block int, n binary"
    names = ["h1", "h2", "plain", "form", "block", "n"]
    like = counts([""], [""]).shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(like, np.int64)
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            plain, forms = [*map(normal, texts)], [*map(shape, texts)]
            total += counts(plain, forms)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(plain, pa.string()), pa.array(forms, pa.string()), pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())], names=names)
        for block, n in _sent(blocks(total)):
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, block, n], names=names)

    rows = df.select(F.col(text).alias("text")).where("text IS NOT NULL").selectExpr(*COPY, "text")
    rows = rows.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    kept = durable(rows.mapInArrow(run, schema), "forms")
    n, forms = added(kept.where("block IS NOT NULL"), like), kept.where("block IS NULL").select("h1", "h2", "plain", "form")
    first = sent(contrasted(n))
    model = contrasted(n, summed(forms, lambda plain, form: wording(first.value, plain, form)))
    now = sent(model)
    return bounded(model, summed(forms, lambda plain, form: spread(now.value, plain, form))), forms


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", model: ResidueModel | None = None) -> DataFrame:
    """key, MEASURES and is_residue of every row, over whole texts.

    Null, empty and blank texts are no residue (all measures 0). Keys may be null or repeated;
    extra columns are not read. Without a model one is fitted on the texts themselves, all of them,
    and copies are measured once; with one it is one pass over two columns without any shuffle.
    """
    out = [*MEASURES, "is_residue"]
    types = [*(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("is_residue", T.BooleanType())]
    forms = None
    if model is None:
        model, forms = fit_corpus(df, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def result(m: np.ndarray) -> list[pa.Array]:
        return [*(pa.array(x) for x in m.T.copy()), pa.array(cases(m))]

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = measure(sent.value, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *result(m)], names=[key, *out])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = measured(sent.value, b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *result(m)], names=["h1", "h2", *out])

    if forms is None:
        return df.select(key, text).mapInArrow(direct, T.StructType([df.schema[key], *types]))
    by_copy = forms.mapInArrow(once, T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()), *types]))
    # a null text meets nothing, and its first hash is of the key, so that many of them are not one group
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.selectExpr("key", "if(text IS NULL, xxhash64(cast(key as string)), xxhash64(text)) AS h1", "if(text IS NULL, NULL, hash(text)) AS h2")
    joined = rows.join(by_copy, ["h1", "h2"], "left")
    return joined.select(F.col("key").alias(key), *(F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES), F.coalesce("is_residue", F.lit(False)).alias("is_residue"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).where("is_residue").select("doc_id")


QUERIES = {"p8_found": p8_found}
ORACLE: dict = {}
