"""The numbered queries' own columns on the smallest tables: by SQL, by the libraries, or by plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from wareknit.llm.common import default_tokenizer
from wareknit.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def got(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_by_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    want = Counter(cur.fetchall())
    assert Counter(tuple(r) for r in df.select(*names).collect()) == want and want


def test_op4(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = got(spark, sf_dir, "op4_token_counts")
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(text.encode()), n, n > 2048)


def test_op5(spark, sf_dir, docs):
    def fingerprint(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    rows = got(spark, sf_dir, "op5_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", top(i)) for i in docs}


def test_op6(spark, sf_dir, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer("piece_bpe_32k.model"))
    rows = got(spark, sf_dir, "op6_pieces")
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_eos=True)
        assert tuple(rows[i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_op7(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json")), 0
    rows = got(spark, sf_dir, "op7_id_file")
    assert rows.keys() == docs.keys()
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 2]
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op9(spark, sf_dir, docs):
    rows, slots = got(spark, sf_dir, "op9_shards"), defaultdict(list)
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        r = rows[i]
        assert (r.size, r.text_crc32, r.law) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 16 for r in rows.values())
