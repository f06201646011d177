"""Personal data: patterns, and terms that reveal what the patterns protect.

The base finds e-mail addresses, IP addresses, card and phone numbers.  Hiding
them isn't enough where other words give them away, so information-theoretic
sanitisation follows: with every found value as a protected entity e and every
word t of the same text, the corpus gives

    IC(e) = -log p(e)        PMI(t; e) = log(p(t, e) / (p(t) p(e)))

p(.) being shares of distinct texts.  PMI(t; e) = IC(e) would mean that t
appears only with e, so t alone discloses e; a term with PMI >= ``alpha`` IC(e)
that is in at least ``support`` distinct texts exceeds the disclosure threshold.
The corpus can't estimate a value of fewer texts than that: such an entity backs
off to its narrowest class in ``support`` texts, the mail domain, network, issuer
or area code, else the kind, and terms that disclose the class go.  All the term's
occurrences, in whatever text, become spans of kind ``term``, to be removed
(``redact``) like the base spans, which are generalised to their kind.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import packed, text_key, unpacked, written

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_RE = {k: re.compile(p) for k, p in PATTERNS.items()}
# Whether an address follows is the same from every digit of a run, and a match ends with
# its run, so only a run's first digit is tried: time is linear in digits without dots.
_RE["ip"] = re.compile("(?<![0-9])" + PATTERNS["ip"].replace("+", "++"))
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_LEFT = re.compile(r"^[^\w]+")
#: Slots of the filter that words pass before they are joined with the wanted terms.
_SLOTS = 1 << 23


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in s.split(".")))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str):
    """Matches of the e-mail pattern: only what surrounds an @ is looked at."""
    local = "._%+-"
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in local):
            start -= 1
        m = _RE["email"].match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, kind in enumerate(KINDS[1:], 1):
            if kind == "phone" and "+" not in text:
                continue
            out += [(m.start(), k, m.end()) for m in _RE[kind].finditer(text) if _valid(kind, m.group())]
    return sorted(out)


def value_of(kind: int, s: str) -> str:
    """The entity behind a span: spellings of one address or number are one entity."""
    return f"{KINDS[kind]}:{s.lower() if kind == 0 else s if kind == 1 else _digits(s)}"


def classes_of(entity: Column) -> list[Column]:
    """The classes of an entity, narrowest first: itself, its mail domain, network of
    an address, issuer of a card or area code, its kind."""
    kind = F.substring_index(entity, ":", 1)
    broad = (F.when(kind == "email", F.concat(F.lit("email:@"), F.substring_index(entity, "@", -1)))
             .when(kind == "ip", F.concat(F.substring_index(entity, ".", 3), F.lit(".*")))
             .when(kind == "card", F.concat(F.substring(entity, 1, 11), F.lit("*")))
             .otherwise(F.concat(F.substring(entity, 1, 10), F.lit("*"))))
    return [entity, broad, F.concat(kind, F.lit(":*"))]


def term_of(word: str) -> str:
    return _EDGE.sub("", word).lower()


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that hold no base span."""
    out, i, until = [], 0, 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while i < len(spans) and spans[i][0] < b:
            until = max(until, spans[i][2])
            i += 1
        if until <= a:
            out.append((a, b))
    return out


def _slots(terms: DataFrame) -> np.ndarray:
    """Bit set of the terms' slots: of fixed size, however many terms there are."""
    at = F.crc32(F.encode("term", "utf-8")) % _SLOTS
    one = F.lit(1).cast("long")
    rows = (terms.select((at / 32).cast("long").alias("w"), (at % 32).cast("int").alias("b")).groupBy("w")
            .agg(F.bit_or(F.call_function("shiftleft", one, F.col("b"))).alias("bits")).collect())
    out = np.zeros(_SLOTS // 32, np.uint32)
    for w, bits in rows:
        out[w] = bits
    return out


def term_places(d: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term, s, e) of every occurrence of ``terms`` in all texts of ``d`` (key, text)."""
    slots = _slots(terms)

    def places(batches):
        memo = {}  # word to its term, None if no wanted term has its slot

        def wanted(w):
            if w not in memo:
                t = term_of(w)
                h = zlib.crc32(t.encode()) % _SLOTS
                memo[w] = t if t and slots[h >> 5] >> np.uint32(h & 31) & np.uint32(1) else None
            return memo[w]

        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(memo) > 300_000:
                    memo.clear()
                if not t or not any(map(wanted, set(_TERM.findall(t)))):
                    continue
                for s, e in free_words(t, base_spans(t)):
                    term = wanted(t[s:e])
                    if term:
                        s += len(t[s:e]) - len(_LEFT.sub("", t[s:e]))
                        rows.append((k, term, s, s + len(_EDGE.sub("", t[s:e]))))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ty) for c, ty in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64()))],
                names=["key", "term", "s", "e"])

    # joined on the struct, so both sides are dealt anew and AQE can split a hot term
    return (d.mapInArrow(places, "key binary, term string, s long, e long").withColumn("at", F.struct("term"))
            .join(terms.select(F.struct("term").alias("at")), "at", "left_semi").drop("at"))


def disclosing_places(docs: DataFrame, text: str, support: int, alpha: float) -> DataFrame:
    """(key, term, s, e) of every occurrence of the terms over the disclosure threshold in ``docs``."""
    def found(batches):
        for b in batches:
            rows = set()
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = base_spans(t)
                if spans:
                    rows |= {(k, value_of(i, t[s:e]), None) for s, i, e in spans}
                    rows |= {(k, None, x) for x in {term_of(t[s:e]) for s, e in free_words(t, spans)} if x}
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ty) for c, ty in zip(cols, (pa.binary(), pa.string(), pa.string()))],
                names=["key", "entity", "term"])

    d = docs.select(text_key(text).alias("key"), F.col(text).cast("string").alias("text"))
    rows = written(d.mapInArrow(found, "key binary, entity string, term string").distinct(), "pii-found")
    held = rows.where("term is null").select("key", F.col("entity").alias("value"), F.posexplode(
        F.array(*classes_of(F.col("entity")))).alias("level", "entity"))
    sizes = (held.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
             .where(F.col("n_e") >= support))
    # each value is protected as its narrowest class that ``support`` texts have
    chosen = (held.select("value", "level", "entity").distinct().join(sizes, "entity")
              .groupBy("value").agg(F.min(F.struct("level", "entity", "n_e")).alias("c")))
    protected = written(held.where("level = 0").select("key", "value").join(chosen, "value")
                        .select("key", "c.entity", "c.n_e").distinct(), "pii-protected")
    total = d.select("key").distinct().count()
    ic = -F.log(F.col("n_e") / F.lit(total))
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    discloses = (ic > 0) & (pmi >= alpha * ic) & (F.col("n_t") >= support)
    # a term is in at least as many texts as it is with any entity in, and in ``support``
    # if it counts, so with that number PMI is an upper bound: none that discloses goes
    words = rows.where("entity is null").select("key", "term")
    beside = words.groupBy("term").agg(F.greatest(F.count("*"), F.lit(support)).alias("n_t"))
    joint = (words.join(protected, "key").groupBy("entity", "term")
             .agg(F.count("*").alias("n"), F.max("n_e").alias("n_e")))
    wanted = written(joint.join(beside, "term").where(discloses).select("entity", "term", "n", "n_e"), "pii-wanted")
    # where the wanted terms appear, with an entity or not, and in how many distinct texts
    places = written(term_places(d, wanted.select("term").distinct()), "pii-places")
    df = places.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    terms = wanted.join(df, "term").where(discloses).select(F.struct("term").alias("at")).distinct()
    return places.withColumn("at", F.struct("term")).join(terms, "at", "left_semi").drop("at")


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def redact_text(text: str | None, spans: str) -> str | None:
    """``text`` with every span replaced: base spans by ``[kind]``, terms removed.
    Where spans overlap, the one that begins first holds."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",")):
        if int(s) >= at:
            out += [text[at:int(s)], "" if kind == "term" else f"[{kind}]"]
            at = int(e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text: str = "text", support: int = 3, alpha: float = 0.9,
             redacted: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``n_email n_ip n_card n_phone base_spans spans``
    (and ``redacted``, the sanitised text, if asked for).

    ``base_spans`` and ``spans`` list kind:start:end by start, then kind in the
    order of ``KINDS``, terms last; code points, end exclusive, "" for none.
    Null and empty texts have none.  Equal texts count once in the statistics,
    so copies reveal nothing that one text doesn't.  Columns of ``docs`` with the
    names of results give way to the results.
    """
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_spans"]
    drop = {*new, "spans", "redacted", text.lower()}
    kept = [c for c in docs.columns if c.lower() not in drop]

    def scan(batches):
        for b in batches:
            rows = [base_spans(t) for t in b.column(b.num_columns - 1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in r) for r in rows], pa.int64()) for i in range(4)]
            joined = [_joined([(s, e, KINDS[k]) for s, k, e in r]) for r in rows]
            cols = list(b.columns) if redacted else list(b.columns[:-1])
            yield pa.RecordBatch.from_arrays([*cols, *counts, pa.array(joined, pa.string())],
                                             names=[*names, *new])

    src = docs.select(packed(docs, kept), text_key(text).alias("_key"),
                      F.col(text).cast("string").alias("_text"))
    names = src.columns if redacted else src.columns[:-1]
    schema = T.StructType(list((src if redacted else src.drop("_text")).schema.fields))
    for c in new[:4]:
        schema = schema.add(c, "long")
    base = src.mapInArrow(scan, schema.add("base_spans", "string"))

    hits = (disclosing_places(docs, text, support, alpha)
            .groupBy("key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("_terms")))
    # joined on the struct, so both sides are dealt anew and AQE can split the copies of a text
    hits = hits.select(F.struct("key").alias("_at"), "_terms")
    j = base.withColumn("_at", F.struct(F.col("_key").alias("key"))).join(hits, "_at", "left")
    # both lists hold few spans a document; merged in the JVM by (start, kind, end)
    parts = F.filter(F.split("base_spans", ","), lambda x: x != "")
    order = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    as_struct = F.transform(parts, lambda x: F.struct(
        F.element_at(F.split(x, ":"), 2).cast("long").alias("s"),
        F.array_position(order, F.element_at(F.split(x, ":"), 1)).cast("int").alias("k"),
        F.element_at(F.split(x, ":"), 3).cast("long").alias("e")))
    extra = F.transform(F.coalesce("_terms", F.array().cast("array<struct<s:bigint,e:bigint>>")),
                        lambda x: F.struct(x["s"].alias("s"), F.lit(5).alias("k"), x["e"].alias("e")))
    spans = F.array_join(F.transform(F.sort_array(F.concat(as_struct, extra)), lambda x: F.concat_ws(
        ":", F.element_at(order, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    out = j.withColumn("spans", spans)
    if not redacted:
        return out.select(*unpacked(kept), *new, "spans")
    clean = F.udf(redact_text, "string", useArrow=True)
    return out.select(*unpacked(kept), *new, "spans", clean("_text", "spans").alias("redacted"))
