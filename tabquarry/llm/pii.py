r"""Personal data: patterns, and information-theoretic sanitisation of the terms that give protected entities away.

1. Base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping
   for each kind, in code points.
2. Terms: a word is a run of anything but the six ASCII blanks; its term is the word without the punctuation at its ends,
   in lower case. Every term is a candidate, of any length and with any digits, where it lies outside the base spans.
   Beyond ``TERM_CHARS`` characters a digest stands for it in all tables (``term_of``).
3. Disclosure: each distinct value of a base span is a protected entity. All counts are of different texts: n(t, e) of
   those where t is one of the ``WINDOW`` whole words before or behind an occurrence of e, n(t) and n(e) of those that hold t or e, n of all
   that are not empty. A term with n(t, e) >= ``MIN_SUPPORT``, p(e | t) = n(t, e) / n(t) >= ``DISCLOSE`` and pointwise
   mutual information of at least ``MIN_BITS`` reveals the entity: each of its occurrences becomes a span ``term``.
   Exact copies of a text count once, so they turn none of its words into a disclosure. Texts that differ anywhere count
   each, as the same signature under different texts is the strongest disclosure; near-copies are for ``neardup`` to take
   out first, as the pipeline does.
4. Sanitising: base spans are generalised to their kind in brackets; terms are generalised to [TERM], or removed if
   p(e | t) >= ``REMOVE``.

The terms to look up are broadcast only up to ``BROADCAST_TERMS`` of at most ``TERM_CHARS`` characters each (or their
digest); beyond, texts and terms are joined on the term.

Cases: null text counts as empty; repeated rows are treated each; an empty table gives no rows; further columns pass
through ``sanitise``; matches that fail their check are dropped and not tried again at another place.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, files_for, fresh, table

KINDS = ("email", "ip", "card", "phone")
WINDOW = 5
MIN_SUPPORT, DISCLOSE, REMOVE, MIN_BITS = 3, 0.5, 0.9, 6.0
BROADCAST_TERMS, TERM_CHARS = 100_000, 64
#: Bytes of texts for each file of the tables of entities and terms, which are far smaller.
TEXT_BYTES = 16 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# the optional tail makes a digit run that starts no address match alone, so a run is never tried from its middle
_IP = re.compile(r"[0-9]+(?:(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Terms that may lie in a base span: its words have a digit or an at sign, or are separators of a phone number; and digests.
_BASE_LIKE = re.compile(r"[0-9@]|^[().-]+$|^\x20")
_EDGE = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Only the at signs are tried: the part before one starts where its characters or the last match end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def term_of(word: str) -> str:
    """The term of a word; for a long one a blank, which no word has, and its digest."""
    t = word.strip(_EDGE).lower()
    return t if len(t) <= TERM_CHARS else " " + hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def words_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of each word, without the punctuation at its ends; no term if it touches a base span."""
    out, cover, i = [], [], 0
    for s, _, e in base:
        if cover and s < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], e)
        else:
            cover.append([s, e])
    for m in _WORD.finditer(text):
        w = m.group().lstrip(_EDGE)
        s = m.end() - len(w)
        e = s + len(w.rstrip(_EDGE))
        while i < len(cover) and cover[i][1] <= s:
            i += 1
        out.append((s, e, "" if i < len(cover) and cover[i][0] < e else term_of(w)))
    return out


def contexts(text: str) -> set[tuple[int, str]]:
    """(entity, term) of one text; the empty term stands for the entity itself."""
    base, out = base_spans(text), set()
    if not base:
        return out
    words = words_of(text, base)
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    for s, k, e in base:
        entity = _digest(KINDS[k], text[s:e].lower())
        i, j = bisect_right(ends, s), bisect_left(starts, e)
        out.add((entity, ""))
        out.update((entity, t) for _, _, t in words[max(0, i - WINDOW) : i] + words[j : j + WINDOW] if t)
    return out


def terms_in(text: str, known=None) -> set[str]:
    """The terms of a text outside its base spans, or those of them in ``known``."""
    split = set(text.encode("utf-8", "surrogatepass").split())  # bytes split at the six blanks of _WORD
    found = {term_of(w.decode("utf-8", "surrogatepass")) for w in split}
    found = found & known.keys() if known is not None else found - {""}
    doubtful = {t for t in found if _BASE_LIKE.search(t)}
    if doubtful and (base := base_spans(text)):
        found = (found - doubtful) | (doubtful & {t for _, _, t in words_of(text, base)})
    return found


def term_spans(text: str, terms, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    return [(s, e) for s, e, t in words_of(text, base) if t and t in terms]


def _by_word(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text hash, term) of the texts that hold one of ``terms``.

    With a column ``most`` a task names at most ``most`` + 1 different texts for a term: that is enough to tell that the
    term is held by more than ``most``.
    """
    bounded = "most" in terms.columns
    limit = terms.limit(BROADCAST_TERMS + 1).count()
    texts = docs.select("text", F.xxhash64("text").alias("th")).where(F.length("text") > 0)
    if limit <= BROADCAST_TERMS:
        held = docs.sparkSession.sparkContext.broadcast({r["term"]: r["most"] if bounded else None for r in terms.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, seen = held.value, {}
            for b in batches:
                hs, ts = [], []
                for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for w in terms_in(t, known) if known else ():
                        if known[w] is not None:
                            texts_of = seen.setdefault(w, set())
                            if h in texts_of or len(texts_of) > known[w]:
                                continue
                            texts_of.add(h)
                        hs.append(h)
                        ts.append(w)
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ts, pa.string())], ["th", "term"])

        return texts.mapInArrow(run, "th long, term string")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(terms_in(t))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array(found, pa.string())], ["th", "term"])

    return texts.mapInArrow(words, "th long, term string").join(terms.select("term"), "term")


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(term, disclosure): the terms that reveal a protected entity, with their largest p(e | t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r, h) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in contexts(t)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["entity", "term", "th"])

    texts = docs.select("text", F.xxhash64("text").alias("th")).where(F.length("text") > 0)
    n = texts.select("th").distinct().count()
    seen = texts.mapInArrow(run, "entity long, term string, th long").distinct()
    pairs = cut(seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where((F.col("n_te") >= MIN_SUPPORT)).coalesce(files_for(docs, TEXT_BYTES)))
    # p(e | t) is at most 1, so an entity in more texts than this reaches MIN_BITS with no term
    n_e = pairs.where("term = ''").select("entity", F.col("n_te").alias("n_e")).where(F.log2(n / F.col("n_e")) >= MIN_BITS)
    near = pairs.where("term != ''").join(n_e, "entity")
    # p(e | t) stays below DISCLOSE if more texts than this hold the term
    most = near.groupBy("term").agg(F.floor(F.max("n_te") / DISCLOSE).alias("most"))
    n_t = _by_word(docs, most).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = F.col("n_te") / F.col("n_t")
    bits = F.log2(share * n / F.col("n_e"))
    return near.join(n_t, "term").where((share >= DISCLOSE) & (bits >= MIN_BITS)).groupBy("term").agg(F.max(share).alias("disclosure"))


def _with_terms(docs: DataFrame, terms: DataFrame, name: str):
    """(docs with a column of the row's own terms or null, the broadcast terms or None)."""
    terms = cut(terms.coalesce(files_for(docs, TEXT_BYTES)))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        held = docs.sparkSession.sparkContext.broadcast({r["term"]: r["disclosure"] for r in terms.collect()})
        return docs.withColumn(name, F.lit(None).cast("map<string,double>")), held
    th = fresh(docs, "__th")
    own = (
        _by_word(docs, terms).distinct().join(terms, "term").groupBy("th")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias(name)).withColumnRenamed("th", th)
    )
    return docs.withColumn(th, F.xxhash64("text")).join(own, th, "left").drop(th), None


def all_spans(text: str, terms: dict[str, float]) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    if not terms:
        return base
    return sorted(base + [(s, len(KINDS), e) for s, e in term_spans(text, terms, base)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "term")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, counts of each kind, digest of the base spans, all spans, number of term spans."""
    marked, held = _with_terms(docs.select("doc_id", "text"), disclosing_terms(docs) if terms is None else terms, "__own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = held.value if held else None
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = all_spans(t or "", shared if shared is not None else dict(own or ()))
                kinds = [k for _, k, _ in spans]
                for k in range(5):
                    out[k].append(kinds.count(k))
                out[5].append(hashlib.sha256(joined([x for x in spans if x[1] < len(KINDS)]).encode()).hexdigest())
                out[6].append(joined(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:5]], *[pa.array(c, pa.string()) for c in out[5:]]], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "n_term", "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", base_sha256 string, spans string")


def cleaned(text: str, terms: dict[str, float]) -> str:
    """The text with its spans generalised or removed; overlapping spans are one, named after the first."""
    merged: list[list[int]] = []
    for s, k, e in all_spans(text, terms):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    out, at = [], 0
    for s, k, e in merged:
        gone = k == len(KINDS) and terms.get(term_of(text[s:e]), 0.0) >= REMOVE
        out += [text[at:s], "" if gone else f"[{(*KINDS, 'term')[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with its texts cleaned; all other columns stay."""
    own, rest, new = fresh(docs, "__own"), fresh(docs, "__row"), fresh(docs, "__new")
    marked, held = _with_terms(docs, disclosing_terms(docs) if terms is None else terms, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = held.value if held else None
        for b in batches:
            texts = [None if t is None else cleaned(t, shared if shared is not None else dict(o or ())) for t, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], [new, rest])

    others = [c for c in docs.columns if c.lower() != "text"]
    whole = marked.select("text", own, F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in others]).alias(rest))
    done = whole.mapInArrow(run, f"`{new}` string, `{rest}` {whole.schema[rest].dataType.simpleString()}")
    return done.select(*[F.col(new).alias(c) if c.lower() == "text" else F.col(f"{rest}.`{c}`") for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
