"""The text operators against brute force, libraries, exact round trips and held-out labels, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareknit.llm import chat, counts, decontam, idfile, langid, neighbours, pieces, shards, simhash, toxicity
from wareknit.llm.bpe import Bpe
from wareknit.llm.common import default_tokenizer
from wareknit.llm.memo import Memo

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and red blue cup jar one two three café naïve 12 3.5 don't we'll été".split()


def text_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", ", ", "  ", ". "]) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    long_text = text_of(rng, 20_000)
    texts = [None, "", " ", "\n\n", "a", "!!!", "a b", "word " * 50, long_text, "Привет мир", "日本語 текст", "a▁b  c", "\x00\x01 x", "<|endoftext|> </s>", "é" * 500, "x" * 3000, "a  b", "  lead", "trail  "]
    texts += ["same text in many rows here"] * 30 + [text_of(rng, k) for k in range(40)]
    return [(i, t, ["en", "de", None][i % 3], "src", 1) for i, t in enumerate(texts)] + [(3, "again", "en", "s", 0), (3, "again", "en", "s", 0), (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, odd and long texts, ties, repeated rows, and columns with the names of results and internals."""
    df = spark.createDataFrame(odd_rows(), DOCS)
    clashing = ("ids", "bucket", "shard", "slot", "hits", "guess", "score", "digest", "n_tokens", "fp", "part", "key", "grown_shard")
    return df.withColumns({c: F.lit("clash") for c in clashing}).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_pieces_match_the_library(spark, odd, nothing):
    import sentencepiece

    path = default_tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_documents(odd, path).join(odd.select("doc_id", "text"), "doc_id").collect():
        want = lib.encode(r.text or "", add_eos=True)
        if r.doc_id != 3:
            assert r.ids == want and r.decoded == lib.decode(want)
    assert pieces.encode_documents(nothing, path).count() == 0


def test_piece_encoder_on_random_texts():
    import sentencepiece

    path = default_tokenizer("piece_bpe_32k.model")
    lib, m, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path), random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab  ▁\n\téж漢😀the ing0") for _ in range(rng.randint(0, 50)))
        ids = np.frombuffer(m.encode(t), np.int32).tolist()
        assert ids == lib.encode(t, add_eos=True) and m.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_matches_the_library(name):
    b, rng = Bpe(default_tokenizer(name)), random.Random(3)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["".join(rng.choice("aB's  \n\t\xa0\x85éñªº²½_-.,0 ж漢\x1c") for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["x <|ENDOFTEXT|> <|startoftext|>y", "I'LL it's"]
    for t, e in zip(texts, b.lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(b.ids(t), np.uint32).tolist() == e.ids and b.count(t) == len(e.ids)


def test_token_counts_and_cache(spark, odd, nothing, tmp_path):
    path, cache = default_tokenizer("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    b = Bpe(path)
    for _ in range(2):
        got = counts.count_tokens(odd, path, cache)
        assert got.count() == odd.count()
        for r in got.join(odd.select("doc_id", "text"), "doc_id").collect():
            if r.doc_id != 3:
                assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(b.whole(r.text or "")))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second run encoded nothing
    assert counts.count_tokens(nothing, path).count() == 0


def test_packing_round_trip():
    r = np.random.default_rng(0)
    for k in range(1500):
        sizes = r.integers(0, 90, int(r.integers(1, 7)))
        bits = r.integers(1, 17 if k % 3 else 64, sizes.sum())
        x = np.array([int(r.integers(0, 1 << int(b), dtype=np.uint64)) for b in bits], np.uint64)
        words, at = idfile.pack(x, np.cumsum(sizes))
        assert (idfile.unpack(words)[0] == x).all()
        for i, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
            assert (idfile.unpack(words[at[i] : at[i + 1]])[0] == x[a:b]).all()
    assert len(idfile.pack(np.zeros(60, np.uint64))[0]) == 1 and len(idfile.pack(np.full(3, 1 << 63, np.uint64))[0]) == 6


def test_id_file(spark, odd, nothing):
    path = default_tokenizer("byte_bpe_50k.json")
    b = Bpe(path)
    rows = idfile.store_ids(odd, path, 2, 4, ids=True, crc=True).withColumnRenamed("ids_crc32", "crc").collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in rows] == sorted(x[0] if x[0] is not None else -1 for x in odd_rows())
    texts, start = {i: t for i, t, *_ in odd_rows() if i != 3}, 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) and r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id in texts:
            assert r.ids == [*b.whole(texts[r.doc_id] or ""), 2]
        start += r.n_tokens
    assert idfile.store_ids(nothing, path, 2, 4).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST]", None, "", "a<|im_end|>\n<|im_start|>user\nx", "<", "[", "\\", "<|im_sep|>", "x" * 5000, "<<SYS>> </SYS>>"]
    rng, rows = random.Random(1), []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole\\n"]), rng.choice(odd) if rng.random() < 0.7 else "plain"))
    rows += [(100, 1, "user", "tie"), (100, 1, "user", "tie"), (100, None, "user", "first"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("turns", "pieces", "starts", "messages")})
    out = chat.format_conversations(df.repartition(5))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "pieces", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert "".join(p.text for p in got[c].pieces) == got[c].formatted
        runs = sum(1 for i, t in enumerate(turns) if i == 0 or turns[i - 1][0] != t[0])
        assert got[c].formatted.count(chat.START) == runs
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_groups(docs):
    import re

    import xxhash

    fps = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_simhash_groups(spark, odd, nothing):
    rng, base = random.Random(4), [text_of(random.Random(k), 60) for k in range(6)]
    rows = [(1000 + k, " ".join(w if rng.random() > 0.02 else "zz" for w in rng.choice(base).split()), "en", "s", 1) for k in range(150)]
    docs = odd.select(*[c.split()[0] for c in DOCS.split(", ")]).filter("doc_id is not null and doc_id <> 3").unionByName(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: (r.h, r.component_id) for r in simhash.fingerprint_groups(docs).select("*", simhash.fingerprint_hex(F.col("fp")).alias("h")).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.fingerprint_groups(odd).count() == odd.count() and simhash.fingerprint_groups(nothing).count() == 0


def components_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return {frozenset(s) for s in out.values()}


def test_simhash_links_lose_nothing(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(30):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    joined = components_of(fps, want)
    for count in (1, 1 << 26, 1 << 32):
        got = {tuple(sorted(r)) for r in simhash.links(df, count).collect()}
        assert got <= want and components_of(fps, got) == joined  # fewer links, of the same groups


def test_groups_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    rng = random.Random(2)
    rng.shuffle(edges)
    got = {r.node: r.root for r in simhash.groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items()} == {i: 0 for i in range(1, 201)} | {k: 1000 for k in range(1001, 1100)}


def brute_hits(text, items):
    words, hit, found = decontam.words_of(text), set(), set()
    for item, body in items:
        w = decontam.words_of(body)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if w else ():
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit.update(range(i, i + m))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8_000_000, 700])
def test_decontamination(spark, odd, nothing, block_bytes):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.choice([1, 2, 5, 12, 13, 20, 40]))) for k in range(25)]
    items += [(99, items[3][1].upper()), (98, None), (97, "..."), (None, "w1 w2")]
    texts = [make(rng.randint(0, 60)) + " " + rng.choice(items[:25])[1] + ", " + make(rng.randint(0, 60)) for _ in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0], None, ""])], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("text_digest", "hit", "item", "spans")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    known = [(i, b) for i, b in items if b]
    out = decontam.with_hits(docs, bench, "hits", block_bytes=block_bytes).select("text", "hits", decontam.n_hit("hits").alias("n")).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.hits.n_words, r.n, r.hits["items"]) == brute_hits(r.text, known)
    assert decontam.with_hits(odd.drop("hits"), bench.limit(0), "hits").filter("size(hits.items) > 0").count() == 0
    assert decontam.with_hits(nothing.drop("hits"), bench, "hits").count() == 0


@pytest.mark.parametrize("block_bytes", [8_000_000, 60_000])
def test_long_items_are_cut(spark, block_bytes):
    """Windows across the cuts are found, and no block holds a long item whole."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2 * decontam.PIECE_WORDS + 40)]
    cuts = [0, decontam.PIECE_WORDS - 6, decontam.PIECE_WORDS, 2 * decontam.PIECE_WORDS - 1, len(words) - 13]
    docs = [(k, f"x y {' '.join(words[a : a + 13]).upper()} z") for k, a in enumerate(cuts)] + [(50, " ".join(words[5:17]))]
    bench = spark.createDataFrame([(7, " ".join(words)), (None, "y " + " ".join(words[:12]))], "item_id long, text string")
    out = decontam.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), bench, "h", block_bytes=block_bytes)
    got = {r.doc_id: (r.n, r.h["items"]) for r in out.select("doc_id", "h", decontam.n_hit("h").alias("n")).collect()}
    assert got == {k: (14 if k == 0 else 13, ["7"]) for k in range(len(cuts))} | {50: (0, [])}


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)

    def one(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    for n in (1, 2, 16, 17):
        assert [one(int(k), n) for k in keys[:500]] == shards.jump_hash(keys[:500], n).tolist()
    a, b = shards.jump_hash(keys, 16), shards.jump_hash(keys, 17)
    assert set(b[a != b]) == {16} and abs((a != b).mean() - 1 / 17) < 0.01


def test_shards(spark, odd, nothing):
    rows = shards.read_shards(odd, shards.write_shards(odd, 5)).collect()
    assert len(rows) == odd.count() and {r.hits for r in rows} == {"clash"}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert shards.read_shards(nothing, shards.write_shards(nothing, 5)).count() == 0


def brute_grams(text):
    out = defaultdict(int)
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {w} "
        for g in [*w, *(padded[k : k + m] for m in (2, 3) for k in range(len(padded) - m + 1))]:
            out[g] += 1
    return out


def ranked(sums):
    return [g for g, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0].encode()))][: langid.PROFILE]


def brute_profiles(rows):
    sums = defaultdict(lambda: defaultdict(int))
    for _, text, lang in rows:
        for g, n in brute_grams(text).items():
            sums[lang][g] += n
    return {lang: ranked(s) for lang, s in sums.items()}


def brute_language(text, profiles):
    """Out-of-place distance by its definition."""
    own = ranked(brute_grams(text or ""))
    if not own or not profiles:
        return "und", 0.0
    far = langid.PROFILE
    distance = {lang: sum(min(far, abs(p.index(g) - k)) if g in p else far for k, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(distance), key=lambda lang: distance[lang])
    return best, 1 - distance[best] / (far * len(own))


def test_shards_keep_other_columns(spark):
    """Names of internals stay as they are; names of results, in any case, are the results'."""
    docs = spark.createDataFrame([(i, f"t{i}", "b", "f", "s", "n") for i in range(50)], "doc_id long, text string, bucket string, first_slot string, SLOT string, n string")
    rows = shards.read_shards(docs, shards.write_shards(docs, 3)).collect()
    assert len(rows) == 50 and {(r.bucket, r.first_slot, r.n) for r in rows} == {("b", "f", "n")}
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s in range(3) for k in range(sum(x.shard == s for x in rows)))


def test_language_query_by_brute_force(spark, sf_dir):
    """The registered query's rows, on the smallest tables."""
    import __spark_entry__ as entry

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs}
    profiles = brute_profiles([d for d in docs if not out[d[0]] and d[1] is not None and d[2] is not None])
    got = entry.queries()["op3_language"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    text_of_id = {i: t for i, t, _ in docs}
    for r in got:
        lang, score = brute_language(text_of_id[r.doc_id], profiles)
        assert (r.held_out, r.lang_pred) == (out[r.doc_id], lang) and abs(r.score - score) < 1e-12


@pytest.mark.parametrize("window", [1, 2, 7, 1 << 18])
def test_grams_in_windows(window, monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(300):
        text = "".join(rng.choice("abcÀéİΣσ1½ .'\n日") for _ in range(rng.randint(0, 40)))
        codes, n = langid.text_counts(text)
        assert {langid.gram_of(c): k for c, k in zip(codes.tolist(), n.tolist())} == brute_grams(text) and sorted(codes) == codes.tolist()


def test_very_long_text_in_bounded_memory():
    import tracemalloc

    rng = random.Random(0)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(20_000)) * 60  # 8.4 million characters
    tracemalloc.start()
    try:
        for t in (text, text.replace(" ", "")):
            tracemalloc.reset_peak()
            assert langid.text_counts(t)[1].sum() > len(t)
            assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


def test_shards_of_one_key(spark):
    """Rows of one key share a shard, not a bucket."""
    df = spark.createDataFrame([(1 if i % 3 else i, f"text {i}") for i in range(30_000)], "doc_id long, text string")
    rows = shards.read_shards(df, shards.write_shards(df, 2))
    assert rows.filter("doc_id = 1").select("shard").distinct().count() == 1
    for shard in (0, 1):
        own = rows.filter(F.col("shard") == shard)
        assert own.select("slot").distinct().count() == own.count() == own.agg(F.max("slot")).head()[0] + 1


def test_letters_only(spark):
    """Fractions, powers and Roman numerals are no letters."""
    rows = [(0, "½ ² Ⅷ 12", "en"), (1, "a½b", "en"), (2, "", "en"), (3, None, "en"), (4, "ß", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(docs)
    assert profiles == brute_profiles([r for r in rows if r[1]]) or profiles == {k: v for k, v in brute_profiles([r for r in rows if r[1]]).items() if v}
    got = {r.doc_id: r.g for r in docs.select("doc_id", langid.predicted(F.col("text"), profiles).alias("g")).collect()}
    assert [got[i].lang for i in range(5)] == ["und", "en", "und", "und", "de"]


def test_language(spark, odd, nothing):
    words = {"en": "the thing that other", "de": "der die nicht schein", "fr": "le que être ç"}
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(20)), lang, "s", 1) for k in range(90) for lang in [["en", "de", "fr"][k % 3]]]
    docs = spark.createDataFrame([*rows, (500, None, "en", "s", 1), (501, "12 !!", None, "s", 1), (502, "日本語", None, "s", 1)], DOCS)
    docs_text = {r.doc_id: r.text for r in docs.collect()}
    profiles = langid.learn_from_documents(docs)
    assert sorted(profiles) == ["de", "en", "fr"] and all(len(p) <= langid.PROFILE for p in profiles.values())
    got = {r.doc_id: r for r in docs.select("doc_id", "lang", langid.predicted(F.col("text"), profiles).alias("g"), langid.held_out().alias("h")).collect()}
    assert all(r.g.lang == r.lang and 0 < r.g.score <= 1 for i, r in got.items() if i < 500)
    assert got[500].g.lang == got[501].g.lang == "und" and got[502].g.score == 0
    assert all(r.h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert profiles == brute_profiles([(i, t, lang) for i, t, lang, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    for i, r in got.items():
        lang, score = brute_language(docs_text[i], profiles)
        assert r.g.lang == lang and abs(r.g.score - score) < 1e-12
    assert langid.learn_from_documents(nothing) == {}
    assert {r.g.lang for r in odd.select(langid.predicted(F.col("text"), {}).alias("g")).collect()} == {"und"}
    assert odd.select(langid.predicted(F.col("text"), profiles).alias("g")).count() == odd.count()


def test_toxicity(spark, odd, nothing):
    rng, rows, labels = random.Random(10), [], []
    for k in range(600):
        bad = k % 6 == 0
        words = [rng.choice(WORDS) for _ in range(30)] + ([rng.choice(["grobian", "lump", f"schuft{rng.choice('abcdef')}n"]) for _ in range(2)] if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5000, 1, 1), (7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    score = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("s")).collect()}
    held = [(score[k], t) for k, _, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.97 and len(held) > 80
    assert all(0 <= r.s <= 1 for r in odd.select(toxicity.toxicity(F.col("text"), model).alias("s")).collect())
    for none in (marks.limit(0), marks.filter("toxic = 0")):
        assert {r.s for r in odd.select(toxicity.toxicity(F.col("text"), toxicity.learn(docs, none)).alias("s")).collect()} == {0.0}
    assert nothing.select(toxicity.toxicity(F.col("text"), model)).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    noisy = lambda p: np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    good, weak = [noisy(0.85) for _ in range(3)], noisy(0.6)
    votes = np.stack([*good, *[weak] * 8], axis=1)
    given = np.where(rng.random(4000) < 0.85, y, ~y)  # as the operator does, it starts from labels, here noisy ones
    posterior = toxicity.label_model(votes, given.astype(float))
    assert ((posterior > 0.5) == y).mean() > 0.88 > ((votes.sum(axis=1) > 0) == y).mean()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[50:120] = x[50]  # a hot vector
    x[200] *= 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (920, []), (940, [0.0] * 16), (960, [float("nan")] + [1.0] * 15), (980, [None] + [1.0] * 15), (1000, [float("inf")] + [1.0] * 15), (1020, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "vec", "node", "query", "score")})
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, degree=12, beam=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for i, found in got.items():
        s = x.astype(np.float64) @ x[i].astype(np.float64)
        s[i] = -np.inf
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[v] - c) < 1e-9 for _, v, c in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(700), -s.round(9)))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few, F.col("vec_id") == 0).count() == 2


def test_neighbours_of_repeated_ids(spark):
    """Two vectors of one id are two rows; equal rows are one."""
    rng = np.random.default_rng(4)
    rows = [(20, [1.0, 0.0, 0.1]), (20, [0.0, 1.0, 0.2]), (3, [1.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0]), (5, [1.0, 0.0, 0.1]), (40, [0.5, 0.1, 0.3])]
    rows += [(100 + i % 60, rng.standard_normal(3).tolist()) for i in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    known = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for i, v in known:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in known if (j, w) != (i, v))[:20]
            want += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_neighbours_query(spark, sf_dir):
    """The registered query's own rows on the smallest table: recall by brute force, exact scores, the same rows twice."""
    from wareknit.llm.queries import QUERIES

    table = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    runs = [sorted(map(tuple, QUERIES["op2_neighbours"](spark, sf_dir).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    found, hits, wanted = defaultdict(list), 0, 0
    for q, r, v, s in runs[0]:
        found[q].append((r, v, s))
    assert sorted(found) == sorted(ids[ids % 20 == 0].tolist())
    for q, own in found.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist()
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1)) and all(abs(s[np.flatnonzero(ids == v)[0]] - c) < 1e-9 for _, v, c in own)
        hits, wanted = hits + len({v for _, v, _ in own} & set(best)), wanted + len(best)
    assert hits >= 0.9 * wanted


def test_digest_of_known_text(spark, odd):
    ids = odd.filter("doc_id = 4").select(pieces.piece_ids(F.col("text"), default_tokenizer("piece_bpe_32k.model")).alias("i"))
    text = " ".join(map(str, ids.head()[0]))
    got = ids.select(F.sha2(F.array_join(F.col("i").cast("array<string>"), " "), 256)).head()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_with_tiny_memos(name, monkeypatch):
    monkeypatch.setattr("wareknit.llm.memo.MEMO_BYTES", 4000)
    b, rng = Bpe(default_tokenizer(name)), random.Random(4)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcdé.,") for _ in range(rng.randint(1, 6))) for _ in range(60))
        assert np.frombuffer(b.ids(t), np.uint32).tolist() == b.whole(t) and b.count(t) == len(b.whole(t))
    assert b.counts.held < 5000


def test_memo_is_bounded():
    calls = []
    m = Memo(lambda w: calls.append(w) or w.encode(), 2000)
    keys = [f"w{k}" for k in range(400)]
    for _ in range(5):
        assert m.joined(keys) == "".join(keys).encode() and m.held < 2000 + 300
    assert m.one("x" * 1_000_000) == b"x" * 1_000_000 and "x" * 1_000_000 not in m.known
    calls.clear()
    once = Memo(lambda w: calls.append(w) or b"-")
    assert once.all(["a", "b", "a"]) == [b"-"] * 3 and calls == ["a", "b"] and len(once.known) == 2


def test_long_runs_of_blanks():
    import sentencepiece

    path = default_tokenizer("piece_bpe_32k.model")
    lib, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    for t in (" " * 100_000, "a" + " " * 30_001 + "b", "x" * 100_000, "▁" * 5000 + "the", "!" * 20_000, " \n" * 5000):
        assert np.frombuffer(m.encode(t), np.int32).tolist() == lib.encode(t, add_eos=True)


def test_coded_in_slices(spark, odd, monkeypatch):
    """Batches go through in slices; the environment of forked workers doesn't see the patch, so the function is called here."""
    from wareknit.llm import common

    monkeypatch.setattr(common, "SLICE_ROWS", 7)
    import pyarrow as pa

    got = list(common.slices([(pa.array(range(20)), pa.array(range(20))), (pa.array([], pa.int64()), pa.array([], pa.int64()))]))
    assert [len(a) for a, _ in got] == [7, 7, 6, 0] and [x for a, _ in got for x in a.to_pylist()] == list(range(20))
    many = spark.range(4500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    path = default_tokenizer("piece_bpe_32k.model")
    m = pieces.PieceModel(path)
    for r in pieces.encode_documents(many, path).collect():
        assert r.decoded == f"text {r.doc_id}" and r.ids == np.frombuffer(m.encode(r.decoded), np.int32).tolist()


def test_sample_is_bounded(spark):
    """However often an id or a text is repeated."""
    rows = [(k % 50, f"text {k % 700}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    got = toxicity.sampled(docs, labels, 10).collect()
    assert len(got) == 20 and len({(r.text, r.toxic) for r in got}) == 20
    again = toxicity.sampled(docs.repartition(3), labels, 10).collect()
    assert sorted(got) == sorted(again)


def test_scores_by_brute_force(spark):
    """Votes, features and the score of a model, restated."""
    import math

    terms, weights = ["schuft", "lump-", "gut", "schu-"], None
    v = toxicity.Voters(terms, 2)
    rng = np.random.default_rng(4)
    texts = ["", "Schuft!!! LUMPEN GESINDEL ***x", "gut gut schuld", "lumpi lumpig schuft Schuft", None]
    n_votes = len(v.look("")[1])
    weights = rng.standard_normal(len(terms) + n_votes + 1).tolist()
    model = toxicity.Model(terms, 2, weights)
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(toxicity.toxicity(F.col("text"), model).alias("s")).collect()]
    for t, s in zip(texts, got):
        t = t or ""
        words = [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
        has = [any(term == w or (term.endswith("-") and len(w) > len(term) - 1 and w.startswith(term[:-1])) for w in words) for term in terms]
        strong = sum(has[:2])
        times = sum(1 for w in words if any(term == w or (term.endswith("-") and len(w) > len(term) - 1 and w.startswith(term[:-1])) for term in terms[:2]))
        votes = [1 if strong >= k else -1 for k in (1, 2, 3, 5)] + [1 if times >= k else -1 for k in (2, 4)]
        votes += ["LUMPEN GESINDEL" in t, "!!!" in t, "***x" in t] + [int(h) for h in has[:2]]
        z = sum(w for w, h in zip(weights, has) if h) + sum(w * x for w, x in zip(weights[4:-1], votes)) + weights[-1]
        assert len(votes) == n_votes and abs(s - 1 / (1 + math.exp(-z))) < 1e-9
