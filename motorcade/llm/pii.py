"""Personal data by patterns, checksums and context, in Spark SQL expressions only.

Regular expressions propose spans; Luhn (cards) and mod-97 (IBANs) confirm them; whole words within CONTEXT characters
before or behind a span raise its score. Base kinds (email, ip, card, phone) that pass their checks always stay;
further kinds stay at a score of KEEP_AT or more.

The work for a text grows with its length and, by a logarithm, with its matches: offsets are prefix sums by doubling,
and parts of a text are cut from pieces of CHUNK characters rather than from its start.

Edge cases: a null text counts as empty, an empty text has no spans; offsets are code points, the end is exclusive;
spans of different kinds may overlap and all are listed; an IBAN that begins within one confirmed before is none;
columns to keep travel in one struct, so their names never clash; repeated rows give repeated results; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns. A start inside a run that began earlier is excluded by a look-behind and repeats are possessive,
#: which finds the same leftmost matches in linear time; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: An IBAN's pattern is only its head, so that no proposal hides another; its end follows from the country's length, or
#: for countries not listed is the farthest at a word's end that mod-97 confirms.
IBAN_LENGTHS = {
    n: cs.split()
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
IBAN_SHORTEST, IBAN_LONGEST = 15, 34
#: Cheap tests that a text must pass to hold a kind at all.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
#: Score of a span whose checks pass, and what a context word within CONTEXT characters adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": "e-?mails?|mails?|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login|adresse",
    "card": "cards?|visa|credit|pay|paid|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|call|tel|telephone|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
CONTEXT = 40
CONTEXT_GAIN = 0.4
KEEP_AT = 0.6
#: Characters of the pieces that texts are cut from.
CHUNK = 256

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_OK = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    r = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right: letters become 10-35, the first four characters go last."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        a = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(a >= 65, (acc * 100 + a - 55) % 97).otherwise((acc * 10 + a - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _scan(values: Column, join) -> Column:
    """Running results of `join` over an array of integers, by doubling: each step joins what lies 1, 2, 4 ... before."""
    levels = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, level: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), level)
        return F.transform(acc, lambda x, i: F.when(i >= back, join(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(levels, F.transform(values, lambda x: F.nullif(x, F.lit(-1))), step)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text cut into chunks."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    return F.when(end > start, F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start % CHUNK + 1, end - start)).otherwise("")


def _ibans(chunks: Column, heads: Column) -> Column:
    """Heads (start, end, s) grown to whole IBANs that mod-97 confirms; one that begins within another before is none."""
    run = rf"^[A-Z0-9](?: ?[A-Z0-9]){{0,{IBAN_LONGEST - 1}}}+"

    def grown(x: Column) -> Column:
        # one more character than an IBAN can have tells where a word ends
        ahead = _part(chunks, x["start"], x["start"] + 2 * IBAN_LONGEST)
        s = F.regexp_extract(ahead, run, 0)
        at = F.filter(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)) != " ")
        country = F.substr(s, F.lit(1), F.lit(2))
        known = F.coalesce(*[F.when(country.isin(*cs), n) for n, cs in IBAN_LENGTHS.items()])
        sizes = F.when(known.isNotNull(), F.array(known)).otherwise(F.sequence(F.lit(IBAN_LONGEST), F.lit(IBAN_SHORTEST), F.lit(-1)))
        ends = F.filter(F.transform(sizes, lambda n: F.get(at, n - 1)), lambda e: e.isNotNull())
        ends = F.filter(ends, lambda e: ~F.substr(ahead, e + 1, F.lit(1)).rlike("[A-Za-z0-9]") & mod97(F.substr(s, F.lit(1), e)))
        end = F.get(ends, F.lit(0))
        return x.withField("end", x["start"] + end).withField("s", F.substr(s, F.lit(1), end))

    return F.filter(F.transform(heads, grown), lambda x: x["end"].isNotNull())


def _behind(spans: Column, reach: Column) -> Column:
    """Spans that begin at or behind `reach`, the farthest end up to each span, as it is before them; with it as `done`."""
    free = F.zip_with(spans, F.concat(F.array(F.lit(0)), reach), lambda x, r: F.when(x["start"] >= r, x.withField("done", r)))
    return F.filter(free, lambda x: x.isNotNull())


def _valid(kind: str, s: Column) -> Column:
    d = _digits(s)
    return {
        "email": F.lit(True),
        "ip": s.rlike(_IP_OK),
        "card": F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False),
        "phone": F.length(d).between(9, 15),
        "iban": F.lit(True),  # confirmed as it was grown
        "ssn": ~F.substr(s, F.lit(1), F.lit(3)).isin("000", "666"),
    }[kind]


def _near(chunks: Column, x: Column) -> Column:
    """The CONTEXT characters before a span and the CONTEXT behind it, whatever else was found there, in lower case."""
    before = _part(chunks, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"])
    return F.lower(F.concat(before, F.lit("\n"), _part(chunks, x["end"], x["end"] + CONTEXT)))


def _spans(kind: str, placed: Column, chunks: Column) -> Column:
    """(start, kind number, end, score) of a kind's matches (start, end, s) that are confirmed."""
    near = rf"(?<!\p{{L}})(?:{CONTEXT_WORDS[kind]})(?!\p{{L}})"
    score = lambda x: F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(_near(chunks, x).rlike(near), CONTEXT_GAIN).otherwise(0.0))
    ok = F.filter(placed, lambda x: _valid(kind, x["s"]))
    out = F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end"), score(x).alias("score")))
    return out if kind in BASE_KINDS else F.filter(out, lambda x: x["score"] >= KEEP_AT)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, text (null as empty), kept (the `keep` columns, if any), and pii, the array of
    (start, k, end, score) sorted by start and kind; k indexes KINDS."""
    df = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    text, col = F.col("text"), F.col
    none = F.array().cast("array<string>")

    def hits(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found

    def sizes(kind: str) -> Column:
        # a match and the gap before it
        both = F.zip_with(f"hits_{kind}", F.split(text, PATTERNS[kind], -1), lambda h, g: F.length(h) + F.length(g))
        return F.when(some(kind), F.slice(both, F.lit(1), F.size(f"hits_{kind}")))

    some = lambda kind: F.size(f"hits_{kind}") > 0
    df = df.withColumns({f"hits_{k}": hits(k) for k in KINDS})
    df = df.withColumns({f"sizes_{k}": sizes(k) for k in KINDS} | {"chunks": F.when(F.greatest(*[F.size(f"hits_{k}") for k in KINDS]) > 0, _chunks(text))})
    df = df.withColumns({f"ends_{k}": F.when(some(k), _scan(col(f"sizes_{k}"), lambda x, y: x + y)) for k in KINDS})
    at = lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("s"))
    df = df.withColumns({f"placed_{k}": F.when(some(k), F.zip_with(f"hits_{k}", f"ends_{k}", at)) for k in KINDS})
    df = df.withColumn("ibans", F.when(some("iban"), _ibans(col("chunks"), col("placed_iban"))))
    df = df.withColumn("reach", F.when(F.size("ibans") > 0, _scan(F.transform("ibans", lambda x: x["end"]), F.greatest)))
    df = df.withColumn("placed_iban", F.when(F.size("ibans") > 0, F.transform(_behind(col("ibans"), col("reach")), lambda x: x.dropFields("done"))))
    empty = F.array().cast("array<struct<start:int,k:int,end:int,score:double>>")
    spans = F.array_sort(F.concat(*[F.coalesce(F.when(some(k), _spans(k, col(f"placed_{k}"), col("chunks"))), empty) for k in KINDS]))
    return df.select(col("id").alias(id_col), col("text").alias(text_col), *(["kept"] if keep else []), spans.alias("pii"), "chunks")


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with every confirmed span replaced by [KIND]; of overlapping spans the first stands for both.
    All columns stay, in order; a null text stays null; n_chars, where present, is counted anew."""
    found = find_pii(df, id_col, text_col, keep=tuple(df.columns))
    text, chunks, tags = F.col(text_col), F.col("chunks"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = found.withColumn("reach", F.when(F.size("pii") > 0, _scan(F.transform("pii", lambda x: x["end"]), F.greatest)))
    cut = F.transform(_behind(F.col("pii"), F.col("reach")), lambda x: F.concat(_part(chunks, x["done"], x["start"]), F.get(tags, x["k"])))
    clean = F.concat(F.array_join(cut, ""), _part(chunks, F.element_at("reach", -1), F.length(text)))
    found = found.withColumn("clean", F.when(F.col(f"kept.{text_col}").isNotNull(), F.when(F.size("pii") > 0, clean).otherwise(text)))
    new = {text_col: F.col("clean")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.length("clean").cast(df.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in df.columns])


def pii_digest(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans, and their scores in the same order."""
    found = find_pii(df)
    base = F.filter("pii", lambda x: x["k"] < len(BASE_KINDS))
    n = lambda k: F.size(F.filter("pii", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.transform("pii", lambda x: x["score"]).alias("scores"))
