"""Information-theoretic sanitisation of personal data.

Protected entities are found by pattern and confirmed by what such numbers have and others lack: mail addresses;
telephone numbers with a country code, an area code in brackets, the groups of North American or French numbers, or
a word such as "tel" before them; IP addresses (not after a word such as "version"; not 127.0.0.1, ::1 or unspecified);
card numbers by issuer prefix, length, groups and check digit; bank accounts by IBAN check digits; social security numbers
in groups and in the ranges that are given out; other account numbers only behind a word such as "account". Bare runs of
digits are numbers, not persons. With N documents, an entity e has the information
content IC(e) = log2(N / n(e)), and a term t that occurs within WINDOW words of it reveals
PMI(e; t) = log2(N n(e, t) / (n(e) n(t))) of that. All counts are of distinct texts over the whole
corpus, as copies of one text are no independent evidence. The disclosure of t is PMI / IC: 1 if t never occurs but with e. In documents that
mention e, terms of disclosure REMOVE or more are removed, those of GENERALISE or more are
replaced by their class (a word or a number), and e itself, which reveals itself wholly, by its
kind, or by its network where it is an IP address. Where fewer than SUPPORT texts have the pair,
as with most identifiers, n(e, t) / n(t) is replaced by its lower confidence bound (Wilson's, at Z):
terms that are rare in the corpus are then generalised near a rare entity, common ones never are,
and a corpus of under about 700 texts is too small to tell. Documents without an entity stay as
they are.

Defined cases: a null text stays null, an empty one empty; rows with a null id are sanitised as
any other; repeated rows are each sanitised and count as one text; null texts don't count; names that clash get
underscores appended; texts are used whole, in time linear in their length and entities; an empty table gives an empty result.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm.kernel import U64, Words, blocks, text_array
from vectrine.llm.shared import free_name, materialise, prepare

WINDOW = 10
SUPPORT = 3
#: Of the one-sided 95 % bound.
Z = 1.645
REMOVE, GENERALISE = 0.98, 0.8
#: Bits of the filters of hashes that scans are sent: as many as give each value eight places, within these bounds (a filter
#: takes 16 MB at most). A fuller filter lets more through, which is then joined away.
FILTER_BITS = (16, 27)
#: What any text with an entity has, for the whole corpus.
LIKELY = r"@|[0-9](?:[ ().\-/]{0,4}[0-9]){5}|[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}|:[0-9A-Fa-f]{0,4}:"
GAP = r"[ .\-]?"
CUES = {
    "phone": re.compile(r"(?i)(?:\b(?:tel[eé]?|phone|telephone|tel[eé]fono|t[eé]l[eé]phone|telefon|telefonnummer|call|ring|fax|mobile?|m[oó]vil|portable|handy|cell|whatsapp|sms|appelez|llam[ae]|anrufen)\b[.:]?|☎|✆)[\s:.#]{0,3}(?:(?:is|at|us|on|no|nr|num(?:ber)?|n°|unter|au|al)\b[.:]?\s{0,2}){0,3}\Z"),
    "number": re.compile(r"(?i)\b(?:account|acct|a/c|konto(?:nummer)?|cuenta|compte|customer|kundennummer|kunde|client[e]?|passport|pass(?:aporte|eport)?|reisepass|licen[cs]e|iban|policy|steuer-?id|dni|nif|nie|tax\s?id|routing|sort\s?code)\b[\s:.#]{0,3}(?:(?:is|no|nr|num(?:ber|ero|éro)?|n°|id)\b[.:]?\s{0,2}){0,3}\Z"),
    "version": re.compile(r"(?i)(?:\b(?:version|ver|v|release|section|sect|chapter|kapitel|abschnitt|secci[oó]n|clause|build|art(?:icle|ikel|ículo)?|fig(?:ure|ur|ura)?)\b[.:]?|§)\s{0,2}\Z"),
}
#: Characters before a match in which a cue is looked for.
CUE_REACH = 40
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+%\-])[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("ssn", re.compile(r"(?<![\w\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w\-])")),
    ("card", re.compile(r"(?<![\w.+\-])(?:[3-6][0-9]{12,18}|2[2-7][0-9]{14}|([3-6][0-9]{3}|2[2-7][0-9]{2})([ \-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?:\2[0-9]{3})?|3[47][0-9]{2}([ \-])[0-9]{6}\3[0-9]{5})(?![\w\-]|\.[0-9])")),
    ("phone", re.compile(rf"(?<![\w.+])\+[0-9]{{1,3}}(?:{GAP}\(0?[0-9]{{1,5}}\))?(?:{GAP}[0-9]{{1,14}}){{1,5}}(?!\.?[0-9])|(?<![\w.])(?:00[0-9]{{1,3}} ?)?\([0-9]{{2,5}}\)(?:{GAP}[0-9]{{2,8}}){{1,4}}(?!\.?[0-9])")),
    ("phone", re.compile(r"(?<![\w.+\-(])(?:1[ .\-])?[2-9][0-9]{2}([.\-])[2-9][0-9]{2}\1[0-9]{4}(?![\w\-]|\.[0-9])|(?<![\w.+\-(])(?<![0-9] )0[1-9](?:([ .\-]?)[0-9]{2})(?:\2[0-9]{2}){3}(?![ .\-]?[0-9]|\w)")),
    ("cued phone", re.compile(r"(?<![\w.+\-])[0-9(](?:[ ().\-/]{0,2}[0-9]){6,14}(?![\w\-]|\.[0-9])")),
    ("number", re.compile(r"(?<![\w.\-])(?:[A-Z]{0,2}[0-9])(?:[ \-/]?[0-9]){5,19}[A-Z]?(?![\w\-]|\.[0-9])")),
)
LABEL = {"email": "[EMAIL]", "iban": "[BANK ACCOUNT]", "ssn": "[SOCIAL SECURITY NUMBER]", "phone": "[PHONE]", "card": "[CARD NUMBER]", "number": "[ACCOUNT NUMBER]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cue(kind: str, text: str, at: int) -> bool:
    return bool(CUES[kind].search(text[max(0, at - CUE_REACH) : at]))


def _valid(kind: str, m: re.Match) -> tuple[str, str] | None:
    """(kind, normal form) if the match is one."""
    text = m[0]
    if kind == "email":
        return kind, text.lower()
    if kind == "ip":
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        return (kind, str(ip)) if not (str(ip) in ("127.0.0.1", "::1") or ip.is_unspecified or ip.version == 4 and _cue("version", m.string, m.start())) else None
    plain = re.sub(r"[^0-9A-Z]", "", text)
    if kind == "iban":
        return (kind, plain) if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None
    if kind == "card":
        lengths = {"3": (14, 15, 16), "4": (13, 16, 19), "6": (13, 14, 15, 16, 17, 18, 19)}.get(plain[0], (16,))
        return (kind, plain) if len(plain) in lengths and luhn(plain) else None
    if kind == "phone":
        return (kind, plain) if 8 <= len(plain) <= 15 and len(set(plain)) > 1 else None
    if kind == "cued phone":
        return ("phone", plain) if _cue("phone", m.string, m.start()) else None
    if kind == "number":
        return (kind, plain) if _cue("number", m.string, m.start()) else None
    return kind, plain


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of each protected entity, without overlaps, in order."""
    out: list[tuple[int, int, str, str]] = []
    for kind, pattern in PATTERNS:
        starts, new = [e[0] for e in out], []
        for m in pattern.finditer(text):
            k = bisect_left(starts, m.end())
            if (not k or out[k - 1][1] <= m.start()) and (found := _valid(kind, m)):
                new.append((m.start(), m.end(), *found))
        out = sorted(out + new)
    return out


def covered(found: list[tuple[int, int, str, str]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the spans touch an entity."""
    a, b = (np.array([e[k] for e in found], np.int64) for k in (0, 1))
    return np.searchsorted(b, start, "right") < np.searchsorted(a, end, "left")


def generalise(kind: str, value: str) -> str:
    if kind == "ip":
        ip = ipaddress.ip_address(value)
        return f"[IP {'.'.join(value.split('.')[:2])}.x.x]" if ip.version == 4 else f"[IP {':'.join(ip.exploded.split(':')[:2])}:x]"
    return LABEL[kind]


def sanitise_text(text: str, found: list[tuple[int, int, str, str]], actions: dict[int, str]) -> tuple[str, int]:
    """(text with entities generalised and terms treated by ``actions`` (by word hash), terms changed)."""
    cuts = [(a, b, generalise(k, v)) for a, b, k, v in found]
    n = 0
    if actions:
        w = Words(pa.array([text], pa.string()))
        some = np.flatnonzero(np.isin(w.hash.view(np.int64), np.array(sorted(actions), np.int64)) & ~covered(found, w.start, w.end))
        n = len(some)
        cuts += [(int(w.start[k]), int(w.end[k]), {"remove": "", "word": "[TERM]", "number": "[NUMBER]"}[actions[int(w.hash[k].view(np.int64))]]) for k in some]
    out, at = [], 0
    for a, b, new in sorted(cuts):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], n


def lower_bound(x: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share, x of n."""
    p = x / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class Filter:
    """Some of the low bits of a column of hashes, packed: never misses one, lets few others through."""

    def __init__(self, values: DataFrame) -> None:
        wide = int(values.agg(F.approx_count_distinct(values.columns[0])).first()[0]) * 8
        self.low = (1 << min(max(wide.bit_length(), FILTER_BITS[0]), FILTER_BITS[1])) - 1
        page = values.toDF("x").select(F.col("x").bitwiseAND(F.lit(self.low)).cast("int").alias("b")).distinct().withColumn("page", F.shiftright("b", 12))
        got = page.groupBy("page").applyInArrow(_page, "page int, bits binary").toArrow()  # half a kilobyte for each 4,096 places
        self.bits = np.zeros((self.low + 1) // 8, np.uint8)
        for p, bits in zip(got.column("page").to_pylist(), got.column("bits").to_pylist()):
            self.bits[p << 9 : p + 1 << 9] = np.frombuffer(bits, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        b = hashes.view(np.uint64) & U64(self.low)
        return (self.bits[b >> U64(3)] >> (b & U64(7)).astype(np.uint8) & 1).astype(bool)


def _page(group: pa.Table) -> pa.Table:
    b = group.column("b").to_numpy()
    mask = np.zeros(4096, bool)
    mask[b & 4095] = True
    return pa.table({"page": pa.array([int(b[0]) >> 12], pa.int32()), "bits": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())})


def _dirty(text: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.indices_nonzero(pc.match_substring_regex(text, LIKELY)).to_pylist()


def sanitise(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, remove: float = REMOVE, general: float = GENERALISE, text_col: str = "text") -> DataFrame:
    """``docs`` with the text sanitised, and ``pii_entities`` and ``pii_terms``: how many were changed."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    of_row = T.StructType([rows.schema["row"]])

    def mentions(batches):
        for batch in batches:
            text, keep, found, terms = text_array(batch.column(1)), [], [], []
            for i, j in blocks(text):
                part = text.slice(i, j - i)
                for k in _dirty(part):
                    s = part[k].as_py()
                    if not (e := entities(s)):
                        continue
                    w = Words(pa.array([s], pa.string()))
                    inside, near = covered(e, w.start, w.end), []
                    for a, b, kind, value in e:
                        lo, hi = np.searchsorted(w.end, a, "right"), np.searchsorted(w.start, b)
                        at = np.concatenate([np.arange(max(0, lo - window), lo), np.arange(hi, min(len(w.hash), hi + window))])
                        at = at[~inside[at]]
                        near.append({"entity": f"{kind}:{value}", "terms": np.unique(w.hash[at].view(np.int64)).tolist(), "numbers": np.unique(w.hash[at[[s[w.start[q] : w.end[q]].isdigit() for q in at]]].view(np.int64)).tolist() if len(at) else []})
                    keep.append(i + k)
                    found.append([{"a": a, "b": b, "kind": kind, "value": v} for a, b, kind, v in e])
                    terms.append(near)
            if keep:
                span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
                close = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(found, span), pa.array(terms, close)], ["row", "text", "found", "near"])

    span_type = T.ArrayType(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType()).add("kind", T.StringType()).add("value", T.StringType()))
    near_type = T.ArrayType(T.StructType().add("entity", T.StringType()).add("terms", T.ArrayType(T.LongType())).add("numbers", T.ArrayType(T.LongType())))
    shape = T.StructType(list(of_row.fields)).add("text", T.StringType()).add("found", span_type).add("near", near_type)
    held = materialise(rows.filter("text is not null").mapInArrow(mentions, shape).withColumn("rid", F.monotonically_increasing_id()), "pii-mentions")
    each = held.select("rid", F.xxhash64("text").alias("digest"), F.explode("near").alias("m")).select("rid", "digest", "m.entity", "m.terms", "m.numbers")
    n_e = each.select("digest", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = each.select("digest", "entity", F.explode("terms").alias("term"), "numbers").select("digest", "entity", "term", F.array_contains("numbers", F.col("term")).alias("number")).groupBy("digest", "entity", "term").agg(F.max("number").alias("number"))
    n_et = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.max("number").alias("number")).join(n_e, "entity")
    n_et = materialise(n_et, "pii-pairs")

    texts = rows.filter("text is not null").select("text", F.xxhash64("text").alias("digest"))
    copied = materialise(texts.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "pii-copies")
    total = texts.count() - (copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    shared = spark.sparkContext.broadcast(Filter(n_et.select("term")))
    repeated = spark.sparkContext.broadcast(Filter(copied.select("digest")))

    def counted(batches):
        wanted = shared.value
        for batch in batches:
            text, weight = text_array(batch.column(0)), batch.column(1).to_numpy()
            for i, j in blocks(text):
                w = Words(text.slice(i, j - i))
                at = np.flatnonzero(wanted(w.hash))
                doc = np.searchsorted(w.first, at, "right")
                order = np.lexsort((doc, w.hash[at]))
                h, doc = w.hash[at][order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                term, of = np.unique(h[new], return_inverse=True)
                n = np.bincount(of, weight[i:j][doc[new] - 1], len(term))
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    def copies(batches):
        for batch in batches:
            yield batch.filter(pa.array(repeated.value(batch.column("digest").to_numpy())))

    # only texts with copies are sent, once each, to take away what their copies add
    again = texts.mapInArrow(copies, texts.schema).join(copied, "digest").groupBy("digest").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    weighted = texts.select("text", F.lit(1).cast("bigint").alias("weight")).unionAll(again.select("text", (1 - F.col("copies")).alias("weight")))
    n_t = weighted.mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    bounded = F.log2(F.lit(float(total)) * lower_bound(F.col("n_et"), F.col("n_t")) / F.col("n_e"))
    told = n_et.join(n_t, "term").withColumn("told", F.when(ic > 0, F.when(F.col("n_et") >= support, pmi).otherwise(bounded) / ic).otherwise(F.lit(0.0))).filter(F.col("told") >= general)
    told = materialise(told.select("entity", "term", F.when(F.col("told") >= remove, "remove").when(F.col("number"), "number").otherwise("word").alias("action")), "pii-told")
    telling = spark.sparkContext.broadcast(Filter(told.select("term")))

    def holding(batches):
        wanted = telling.value
        for batch in batches:
            text, rid = text_array(batch.column(1)), batch.column(0).to_numpy()
            for i, j in blocks(text):
                w = Words(text.slice(i, j - i))
                at = np.flatnonzero(wanted(w.hash))
                doc = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(rid[i:j][doc]), pa.array(w.hash[at].view(np.int64))], ["rid", "term"])

    # by term first: a term that tells is in few documents, but an entity may have many of both
    there = held.select("rid", "text").mapInArrow(holding, "rid bigint, term bigint").distinct().join(told, "term")
    by_doc = there.join(each.select("rid", "entity").distinct(), ["rid", "entity"]).groupBy("rid").agg(F.collect_set(F.struct("term", "action")).alias("actions"))

    def changed(batches):
        strength = {"word": 0, "number": 1, "remove": 2}
        for batch in batches:
            texts, n_e_, n_t_ = [], [], []
            for s, found, actions in zip(*[batch.column(c).to_pylist() for c in ("text", "found", "actions")]):
                does: dict[int, str] = {}
                for x in actions or ():
                    if strength[x["action"]] >= strength.get(does.get(x["term"]), -1):
                        does[x["term"]] = x["action"]
                new, n = sanitise_text(s, [(f["a"], f["b"], f["kind"], f["value"]) for f in found], does)
                texts.append(new)
                n_e_.append(len(found))
                n_t_.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(n_e_, pa.int32()), pa.array(n_t_, pa.int32())], ["row", "text", "entities", "terms"])

    def clean(batches):
        for batch in batches:
            text = text_array(batch.column(1))
            dirty = [i + k for i, j in blocks(text) for k in _dirty(text.slice(i, j - i)) if entities(text[i + k].as_py())]
            keep = np.ones(len(batch), bool)
            keep[dirty] = False
            kept = batch.filter(pa.array(keep))
            zero = pa.array(np.zeros(len(kept), np.int32))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), zero, zero], ["row", "text", "entities", "terms"])

    done = T.StructType(list(of_row.fields)).add("text", T.StringType()).add("entities", T.IntegerType()).add("terms", T.IntegerType())
    both = held.join(by_doc, "rid", "left").select("row", "text", "found", "actions").mapInArrow(changed, done).union(rows.mapInArrow(clean, done))
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns], F.col("entities").alias(free_name(docs, "pii_entities")), F.col("terms").alias(free_name(docs, "pii_terms")))
