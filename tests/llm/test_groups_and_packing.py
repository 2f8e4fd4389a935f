import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from motorcade.llm import neardup, packing

BPE = P.path("byte_bpe_50k.json")


def sets_of(text, width):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def exact_components(texts, width, percent):
    sets = {i: sets_of(t, width) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def check_groups(spark, texts, width=4, percent=80):
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width, percent).collect()}
    assert got == exact_components(texts, width, percent)
    return got


def test_near_duplicates_against_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = check_groups(spark, texts)
    assert len({c for _, c in got.values()}) < len(got)


def test_chains_hubs_and_large_groups(spark):
    """Copies that are alike only over others, and a bucket of many texts that share a passage without being alike."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, base = {}, [word() for _ in range(120)]
    for i in range(60):
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = word()
        texts[1000 - i] = " ".join(base)
    shared = [word() for _ in range(60)]
    for i in range(120):
        texts[2000 + i] = " ".join(shared + [word() for _ in range(rng.randrange(20, 50))])
    hub = [word() for _ in range(100)]
    for i in range(80):
        copy = list(hub)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(100)] = word()
        texts[3000 + i] = " ".join(copy)
    texts |= {1: None, 2: "", 3: "  ", 4: "one", 5: "ONE ", 6: "one two"}
    check_groups(spark, texts)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count() and all(r.kept for r in got)
    assert neardup.near_duplicates(odd.limit(0), 4).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(nulls, 4).collect()) == [(0, 0, True), (3, 3, True)]


def test_texts_of_one_template_just_under_the_threshold(spark, monkeypatch):
    """Many texts that share most of a template meet in all buckets and share their rarest common shingles; pairs that
    can't reach the threshold by their sizes never become candidates."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(103)]
    texts = {i: " ".join(shared + [word() for _ in range(14 + i % 5)]) for i in range(1500)}
    texts |= {2000 + i: " ".join(shared + [word() for _ in range(12)]) for i in range(20)}
    pairs, likely = [], neardup.likely

    def counted(p, *rest):
        pairs.append(p.count())
        return likely(p, *rest)

    monkeypatch.setattr(neardup, "likely", counted)
    check_groups(spark, texts)
    assert sum(pairs) < 20 * len(texts)


def test_words_that_break_polynomials_are_told_apart(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64."""
    x = "a"
    while len(x) < 2048:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    texts = {1: x, 2: y, 3: f"{x} {y} {x} {y}", 4: f"{y} {x} {y} {x}", 5: " ".join([x, *"cdefghijk"]), 6: " ".join([y, *"cdefghijk"])}
    assert len({c for _, c in check_groups(spark, texts).values()}) == 6


def test_one_id_with_different_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(reversed(words))), (2, " ".join(words[:58])), (3, " ".join(reversed(words[2:]))), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(tuple, neardup.near_duplicates(df, 4).collect()))
    assert first == sorted(map(tuple, neardup.near_duplicates(df.repartition(3), 4).collect())) and len(first) == 5


def test_posterior_bounds():
    least = neardup.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 32 and least[-1] < 0.8 * neardup.BANDS * neardup.ROWS


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 99}


def unpacked(rows, encode, texts, capacity):
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    for doc, pieces in by_doc.items():
        ids = np.array([*encode(texts[doc]), packing.END_ID], np.uint32)
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(texts)
    return by_seq


def test_packing_round_trip(spark, sf, odd):
    full = Tokenizer.from_file(BPE)
    encode = lambda t: full.encode(t, add_special_tokens=False).ids
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd.dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        seqs = unpacked(packing.pack(df, BPE).collect(), encode, texts, 1024)
        sums = [sum(r.length for r in pieces) for pieces in seqs.values()]
        assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sums) <= 0.011 * sum(sums)
    with_ids = packing.pack(docs, BPE, with_ids=True).limit(20).collect()
    assert all(len(r.ids) == r.length for r in with_ids)
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_differencing_is_near_equal_and_window_count_rises():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(1, 1000) for _ in range(rng.randrange(1, 200))]
        k = rng.randrange(1, 30)
        groups = packing.differencing(sizes, k)
        assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(len(sizes)))
        if len(sizes) > 4 * k:
            sums = [sum(sizes[i] for i in g) for g in groups]
            assert max(sums) - min(sums) <= max(sizes)
    assert len(packing.pack_whole([600] * 9, 1024)) == 9
    groups = packing.pack_whole([500, 500, 20, 700, 300], 1024)
    assert len(groups) == 2 and all(sum([500, 500, 20, 700, 300][i] for i in g) <= 1024 for g in groups)


def test_long_runs_of_blanks(spark):
    full = Tokenizer.from_file(BPE)
    encode = lambda t: full.encode(t, add_special_tokens=False).ids
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 300_000 + "b  c", " " * 1_200_000 + "x y", "\u3000" * 200_000 + "\n" + "w" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    unpacked(packing.pack(df, BPE).collect(), encode, dict(enumerate(texts)), 1024)


def test_padding_and_pieces_follow_from_the_grouping(monkeypatch):
    rng = random.Random(7)
    sizes = [rng.randrange(1, 1024) for _ in range(1024)]

    def figures():
        windows = packing.pack_cut(sizes, 1024)
        got = collections.defaultdict(list)
        for w in windows:
            assert sum(p[2] for p in w) <= 1024
            for i, at, n in w:
                got[i].append((at, n))
        for i, size in enumerate(sizes):
            ends = [0]
            for at, n in sorted(got[i]):
                assert at == ends[-1] and n > 0
                ends.append(at + n)
            assert ends[-1] == size
        return 1 - sum(sizes) / (1024 * len(windows)), sum(map(len, windows))

    padding, pieces = figures()
    assert 0 <= padding <= 1.1 * packing.MAX_PADDING
    monkeypatch.setattr(packing, "differencing", lambda sizes, k: [list(range(i, len(sizes), k)) for i in range(k)])
    assert pieces < 0.95 * figures()[1]
    monkeypatch.undo()
    small = [rng.randrange(1, 60) for _ in range(6000)]
    assert sum(map(len, packing.pack_cut(small, 1024))) == len(small)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "name string, text string")
    for kind in ("string", "binary"):
        got = packing.pack(df.withColumn("name", F.col("name").cast(kind)), BPE, id_col="name").collect()
        assert sum(r.length for r in got) == 4 and len({bytes(r["name"], "utf8") if kind == "string" else bytes(r["name"]) for r in got}) == 2


def test_pipeline_stages_on_odd_rows(spark, odd, sf):
    """Nulls, empty and long texts, repeated rows, and columns with the names that the stages use themselves."""
    names = "kept pii rate n_tokens bins posteriors p id copy doc hits_email chunks reach clean h sig bands _null _text _kept _copy text_ missed".split()
    docs = odd.select("*", *[F.lit("x").alias(n) for n in names if n not in odd.columns])
    for d in (docs, docs.limit(0)):
        before = d
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, sf)
            if stage is not corpus_pipeline.pack_windows:
                assert after.columns == docs.columns
                if before.count():
                    assert {r["_null"] for r in after.collect()} == {"x"}
            before = after
        ids = {r.doc_id for r in before.collect()}
        assert ids == ({i for i in range(1, 10) if i != 8} if d is docs else set())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    from motorcade.llm import toxicity
    from motorcade.llm.common import id_crc

    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(id_crc("doc_id") % 3 != 1)
    bad = toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score") >= toxicity.REJECT_AT)
    assert kept.columns == columns and kept.count() == docs.count() - bad.count() and kept.join(bad, "doc_id").count() == 0
    one = corpus_pipeline.drop_near_duplicates(spark, kept, sf)
    groups = exact_components({r.doc_id: r.text for r in kept.collect()}, 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}
    clean = corpus_pipeline.redact_pii(spark, one, sf)
    assert clean.count() == one.count() and not [r for r in clean.collect() if re.search(r"[\w.]+@[\w-]+\.\w", r.text or "")]
    mixed = corpus_pipeline.mix_sources(spark, clean, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    assert corpus_pipeline.run(spark, sf).columns[:2] == ["doc_id", "start"]
