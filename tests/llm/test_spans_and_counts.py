import collections
import hashlib
import random
import re

import public_tokenizers as P
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from motorcade.llm import kernels as K
from motorcade.llm import pii, quality, tokens

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text or ""):
            s, d = m.group(), re.sub(r"[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda s=s: all(int(x) <= 255 for x in s.split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_against_brute_force(spark, sf, odd):
    rng = random.Random(5)
    parts = ["a@b.c", "a@b", "@", "x.y+z@q-1.de_r@s.t", "1.2.3.4", "256.1.1.1", "001.2.3.255.9.9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1", " ", "\n", "é😀", "..", "--", "123456789012", "a@b.c.d.e", "7"]
    made = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = collections.defaultdict(set)
    for r in pii.pii_digest(docs).collect():
        got[r.doc_id].add((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    for i, t in texts:
        s = spans(t)
        n = collections.Counter(x[3] for x in s)
        want = (*[n[k] for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in s).encode()).hexdigest())
        assert want in got[i], (t, s)


def test_pii_method_adds_confirmed_spans(spark):
    rows = [(1, "iban DE89370400440532013000 ok"), (2, "iban DE89370400440532013001 ok"), (3, "my ssn 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:5:27" in got[1] and "iban" not in got[2] and "ssn:7:18" in got[3] and "ssn" not in got[4]


def test_iban_ends_where_its_country_says(spark):
    gb, de, no = "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    xx = next(f"XX{c:02d}ABCD12345678901" for c in range(2, 99) if int("".join(str(int(ch, 36)) for ch in f"ABCD12345678901XX{c:02d}")) % 97 == 1)
    texts = {
        f"IBAN {gb} Please call": [gb], f"{de} BIC COBADEFF": [de], f"{de.replace(' ', '')} A bank": [de.replace(" ", "")], f"{no} 12 4": [no],
        f"{de} {gb} {no}": [de, gb, no], f"AB12 {gb} 7": [gb], f"{xx} Bank": [xx], f"{xx} 77 X": [xx], f"{gb}": [gb], f"é😀 ({de})": [de], f"{gb}a {gb}9 x{gb}": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    for i, (t, want) in enumerate(texts.items()):
        found = [x.split(":") for x in got[i].split(",") if x.startswith("iban")]
        assert [t[int(a) : int(b)] for _, a, b in found] == want, t
    assert pii.redact(df).where("doc_id = 0").first().text == "IBAN [IBAN] Please call"


def test_context_on_both_sides(spark):
    far = "." * pii.CONTEXT
    texts = {
        "SSN 123-45-6789, 234-56-7890 and 345-67-8901": 3, "123-45-6789 is the social security number": 1, "123-45-6789, 234-56-7890: tax": 2,
        f"ssn {far}123-45-6789": 0, f"123-45-6789{far} ssn": 0, f"ssn{far[3:]}123-45-6789": 1, f"123-45-6789{far[3:]}ssn": 1, "123-45-6789": 0, "é😀 123-45-6789 é SSN": 1,
        "taxi 123-45-6789": 0, "syntax: 123-45-6789": 0,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans.count("ssn:") for r in pii.pii_digest(df).collect()}
    assert got == dict(enumerate(texts.values()))
    assert pii.redact(df).where("doc_id = 0").first().text == "SSN [SSN], [SSN] and [SSN]"


def test_scores_say_what_context_adds(spark):
    df = spark.createDataFrame([(1, "call +49 30 1234567 or +49 30 1234568"), (2, "x" * 300 + " +49 30 1234567 " + "y" * 300 + " hotel +49 30 1234567")], "doc_id long, text string")
    got = {r.doc_id: [round(x, 9) for x in r.scores] for r in pii.pii_digest(df).collect()}
    assert got == {1: [1.0, 1.0], 2: [0.7, 0.7]}


def test_many_spans_in_one_text(spark):
    """Offsets and redaction of texts with ten thousands of spans, in time that grows with their number."""
    import time

    took = {}
    for n in (1000, 24_000):
        text = "é" + " ".join(f"u{i}@mail{i % 7}.org," if i % 3 else f"10.0.{i % 256}.{i % 99}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        got = pii.pii_digest(df).first()
        clean = pii.redact(df).first().text
        took[n] = time.perf_counter() - start
        assert got.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in spans(text)).encode()).hexdigest()
        assert got.n_email + got.n_ip == n and clean.count("[EMAIL]") == got.n_email and clean.count("[IP]") == got.n_ip and "@" not in clean
    assert took[24_000] < 60


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "to a@b.co and 1.2.3.4.", 21), (2, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "to [EMAIL] and [IP]." and got[1].n_chars == 20 and got[2].text is None
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert pii.redact(odd.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, held = collections.Counter(wins), set()
    for i, x in enumerate(wins):
        if n[x] > 1:
            held.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(held)


def test_quality_counts_and_verdicts(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    refs = quality.references(docs)
    assert set(refs) <= {"en", "de", "fr", "es"} and refs
    for df in (docs, odd):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.quality(df, refs).collect():
            want = base_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)
    noise = spark.createDataFrame([(1, " ".join(f"%%&|{i}#$" for i in range(200)))], "doc_id long, text string")
    assert not quality.quality(noise, refs).first().kept
    assert quality.quality(noise, {}).first().kept
    assert quality.quality(odd.limit(0), refs).count() == 0


def test_window_hashes_tell_orders_apart():
    for a, b in (("and the the and", "the and and the"), ("a b c d", "d c b a")):
        h = [K.Words(*(lambda d, o: (d, o))(*reversed(K.string_buffers(pa.array([t])))), True).windows(4)[1][0] for t in (a, b)]
        assert h[0] != h[1]


MODEL = P.path("piece_bpe_32k.model")


def test_prefix_counts_are_exact(sf, spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = tokens.PrefixCounter(MODEL)
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    alphabet = "ab  \n\té漢😀<s>/▁.,the ing\x00\r "
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    for t in texts:
        table = c.table(t)
        assert c.count(t) == len(sp.encode(t)) == table[len(t)]
        for i in rng.sample(range(len(t) + 1), min(5, len(t) + 1)):
            assert table[i] == len(sp.encode(t[:i])), (t[:i],)
        budget = rng.randrange(0, 12)
        fit = table.fit(budget)
        assert table[fit] <= budget


def test_token_counts_of_odd_rows(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = tokens.token_counts(odd, MODEL, prefixes=True).collect()
    assert len(got) == odd.count()
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
        assert r.unit_totals[-1] == r.n_tokens
        assert (r.fit_chars == len(t)) or r.over_limit
    assert tokens.token_counts(odd.where(F.lit(False)), MODEL).count() == 0


def test_js_distance_by_definition():
    import math

    rng = random.Random(9)
    for _ in range(50):
        p, q = ([rng.choice([0, 0, 1, 5, 9]) for _ in range(8)] for _ in range(2))
        got = quality.js_distance(quality.np.array([p], float), quality.np.array([q], float))[0, 0]
        if not sum(p) or not sum(q):
            assert got == 1
            continue
        a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda u, v: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(u, v, strict=True) if x)
        assert abs(got - math.sqrt((kl(a, b) + kl(b, a)) / 2)) < 1e-9


def test_histograms_and_references(spark, odd):
    """Classes and common words counted one by one, and a language of few words is no reference."""
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    arr = pa.array(list(texts.values()))
    off, data = K.string_buffers(arr)
    classes, words = quality.histograms(data, off, K.Words(data, off, True))
    for t, c, w in zip(texts.values(), classes, words, strict=True):
        assert c.sum() == len(t) and w.sum() == len(words_of(t))
        low = collections.Counter(re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words_of(t))
        assert {quality.WORDS[i]: n for i, n in enumerate(w[:-1]) if n} == {x: n for x, n in low.items() if x in quality.WORDS}
        assert c[0] == sum("a" <= x <= "z" for x in t) and c[2] == sum("0" <= x <= "9" for x in t)
    rows = [("a b c " * 1000, "en"), ("un mot", "xx"), (None, "yy")]
    assert set(quality.references(spark.createDataFrame(rows, "text string, lang string"))) == {"en"}


def test_lines_and_words_that_break_polynomials():
    x = "a"
    while len(x) < 2048:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    for t in (f"{x}\n{y}\n{x}", " ".join([x, y] * 5), " ".join(f"{x if i % 3 else y} w{i % 4}" for i in range(40))):
        off, data = K.string_buffers(pa.array([t]))
        got = quality.base_counts(data, off)
        assert tuple(int(got[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_counts(t)
