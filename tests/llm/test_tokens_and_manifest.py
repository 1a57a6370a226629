"""Tokenizer alignment, the Merkle manifest and token counts: awkward rows and the registered queries against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from hirelake.llm import alignment, merkle, tokencount, vocab
from hirelake.llm.queries import QUERIES

A, B = vocab.public_path("byte_bpe_50k.json"), vocab.public_path("piece_bpe_32k.model")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, `key` string, pieces int, pairs string, "
          "id int, g string, r long, h string, member int, `_row` string, n_tokens_ int")
TEXTS = [None, "", " ", "  ", "a", " a", "a  b", "a\nb", "a\n\nb", " \n x", "x \n y\n z", "é😀 日本語　 x\r\ny", "<|endoftext|> <s> </s> <0x0A> <unk>",
         "▁", "a▁ b", "a ▁b ", "\x00\x01 b", "\u0085x   y", "don't we're 'll 'x\n's", "\t tab\tx", "👩‍👩‍👧‍👦 ok", "12 345\n67",
         "7" * 30_000 + " " + "a" * 5_000 + "😀" * 2_000, "the same line\n" * 400, "word " * 3_000, "end\n", "\nstart"]
ROWS = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}" if i < 20 else "é" * 3, len(t or "") if i % 4 else None)
        for i, t in enumerate(TEXTS)]
ROWS += [(4, "a", "en", "s0", 1), (4, "a", "en", "s0", 1), (None, "no id", None, "s1", None), (None, None, None, None, None), (100, "Alone", "x", "alone", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (1, "k", 2, "p", 3, "g", 4, "h", 5, "_", 6)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(rows):
    """Rows of sf0.001 as the same tuples."""
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF0001}/documents.parquet'").fetchall()


# --- token counts

def _counted(texts, path=B):
    if path.endswith(".model"):
        return [len(x) for x in vocab.sentencepieces(vocab.model_bytes(path)).encode([t or "" for t in texts])]
    return [len(vocab.byte_bpe(vocab.model_bytes(path)).encode(t or "", add_special_tokens=False).ids) for t in texts]


def _token_rows(rows, limit, path=B):
    return Counter((i, len((t or "").encode()), n, n > limit) for (i, t, *_), n in zip(rows, _counted([r[1] for r in rows], path)))


@pytest.mark.parametrize("path", [B, A, vocab.public_path("word_bpe_49k.json")])
@pytest.mark.parametrize("common", [1_000_000, 1, 20])
def test_token_counts(docs, path, common):
    out = tokencount.token_counts(docs, path, limit=10, common=common)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, out.collect())) == _token_rows(ROWS, 10, path)


def test_token_counts_of_no_rows_and_of_text_ids(spark, none):
    assert tokencount.token_counts(none, B).count() == 0
    named = spark.createDataFrame([("x", "a b"), (None, "a b"), ("x", None)], "name string, body string")
    got = tokencount.token_counts(named, B, id="name", text="body").collect()
    assert Counter((r["name"], r["n_tokens"]) for r in got) == Counter([("x", 2), (None, 2), ("x", 0)])
    with pytest.raises(ValueError):
        tokencount.token_counts(named.withColumnRenamed("name", "n_tokens"), B, id="n_tokens", text="body")


def test_pre_tokens_give_the_count_of_any_text():
    rnd, some = random.Random(3), list(" \n\t\r▁aé😀'sx1.　\u0085\x00<|") + ["  ", "<s>", "<|endoftext|>", "ing", " the"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(3_000)]
    for path in (A, B):
        cut, count = vocab.piece_counter(path[path.rindex("."):], vocab.model_bytes(path))
        assert [sum(count(cut(t))) for t in texts] == _counted(texts, path)


def test_each_distinct_pre_token_is_counted_once(docs):
    rows = tokencount.piece_counts(docs, B).collect()
    cut, count = vocab.piece_counter(".model", vocab.model_bytes(B))
    holders = Counter(p for _, t, *_ in ROWS for p in set(cut(t or "")))
    assert Counter({r["key"]: r["docs"] for r in rows}) == Counter({tokencount._key(p): n for p, n in holders.items()})
    assert max(len(r["key"]) for r in rows) == 65 and max(len(p) for p in holders) > 10_000


def test_op13(spark):
    rows = table(spark)
    assert Counter(map(tuple, QUERIES["op13_token_counts"](spark, SF0001).collect())) == _token_rows(rows, 4096)


# --- alignment

def _aligned(text):
    """Ids, groups and links of one text from the whole text's tokens and their bytes."""
    if not text:
        return None
    a = vocab.byte_bpe(vocab.model_bytes(A), special_as_text=True).encode(" " + text, add_special_tokens=False)
    alphabet, sp = alignment._byte_alphabet(), vocab.sentencepieces(vocab.model_bytes(B))
    ids = sp.encode(text)
    in_a = [bytes(alphabet[c] for c in t) for t in a.tokens]
    names = [sp.id_to_piece(i) for i in ids]
    in_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, names)]
    if not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
        return None
    ends_a, ends_b = list(itertools.accumulate(map(len, in_a))), list(itertools.accumulate(map(len, in_b)))
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in cuts]
    at = {e: k for k, e in enumerate(cuts)}
    for side, (tokens, ends) in enumerate(((a.ids, ends_a), (ids, ends_b))):
        k = 0
        for token, end in zip(tokens, ends):
            groups[k][side].append(token)
            k += end in at
    return a.ids, ids, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])


def _alignment_rows(rows):
    parts = [_aligned(t) for _, t, *_ in rows]
    docs = Counter(p for x in parts if x for p in x[3])
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = Counter()
    for (i, *_), x in zip(rows, parts):
        if x is None:
            out[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in x[2])
        out[(i, len(x[0]), len(x[1]), len(x[2]), sum(x[3].values()), sum(n for p, n in x[3].items() if docs[p] == best[p[0]]),
             sum(n * docs[p] for p, n in x[3].items()), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("common", [500_000, 1, 50])
def test_alignment(docs, common):
    out = alignment.alignment_report(docs, A, B, common=common)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == _alignment_rows(ROWS)


def test_alignment_of_no_rows_and_of_text_ids(spark, none):
    assert alignment.alignment_report(none, A, B).count() == 0
    named = spark.createDataFrame([("x", "a b"), (None, "a b")], "name string, body string")
    assert Counter(map(tuple, alignment.alignment_report(named, A, B, id="name", text="body").collect())) == _alignment_rows([("x", "a b"), (None, "a b")])
    with pytest.raises(ValueError):
        alignment.alignment_report(named.withColumnRenamed("name", "n_a"), A, B, id="n_a", text="body")


def test_pieces_of_any_text_align_like_the_whole(monkeypatch):
    monkeypatch.setattr(alignment, "_KEPT", 500)   # pieces are forgotten again and again
    rnd, some = random.Random(5), list(" \n\t\r▁aé😀'sx1.　\u0085\x1c") + [" the", "\nword", "  ", "ing"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(1, 12))) for _ in range(3_000)]
    aligner = alignment.Aligner(vocab.model_bytes(A), vocab.model_bytes(B))
    for at in range(0, len(texts), 50):
        for t, got in zip(texts[at:at + 50], aligner.documents(texts[at:at + 50])):
            want = _aligned(t)
            if want is None:
                assert got[:5] == (0, 0, 0, 0, "")
            else:
                assert got[:4] == (len(want[0]), len(want[1]), len(want[2]), sum(want[3].values()))
                assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(got[5], got[6])} == want[3]


def test_op11(spark):
    assert Counter(map(tuple, QUERIES["op11_alignment"](spark, SF0001).collect())) == _alignment_rows(table(spark))


# --- manifest

def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    i, text, lang, source, n = row
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def _climb(nodes):
    """Levels from ``nodes`` to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_h("".join(low[i:i + 16])) for i in range(0, len(low), 16)])
    return levels


def _siblings(levels, at):
    out = []
    for low in levels[:-1]:
        run = at // 16 * 16
        out.append((low[run:at], low[at + 1:run + 16]))
        at //= 16
    return out


def _manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = _climb([_leaf(r) for r in by_source[s]])
    top = _climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(by_source[s]):
            steps = _siblings(trees[s], at) + _siblings(top, k)
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
            node = _leaf((r[0], low, *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r)
            for left, right in steps:
                node = _h("".join(left) + node + "".join(right))
            out.append((r[0], _leaf(r), trees[s][-1][0], top[-1][0], _h("".join(x for step in steps for side in step for x in side)), node, node == top[-1][0]))
    return out


def _op12(docs):
    m = merkle.build(docs, keep={"doc_id": F.col("doc_id")})
    path = F.col("path")
    return m.proofs().select("member.doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), merkle.proof_digest(path).alias("p"),
                             merkle.fold(F.col("leaf"), path).alias("folded"))


def _untampered(rows):
    return Counter((*x[:5], x[3]) for x in _manifest(rows))


def test_manifest(docs, none):
    assert Counter(map(tuple, _op12(docs).collect())) == _untampered(ROWS)
    m = merkle.build(none, keep={"doc_id": F.col("doc_id")})
    assert m.root is None and m.proofs().count() == 0


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17,), (256,), (257,), (4096, 1, 300), (4097, 15), (1,) * 300])
def test_manifest_at_the_edges_of_blocks(spark, sizes):
    rows = [(k * 10_000 + i, f"Text {i}", "en", f"src{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert Counter(map(tuple, _op12(docs).collect())) == _untampered(rows)


def test_a_changed_leaf_does_not_fold_to_the_root(docs):
    m = merkle.build(docs, keep={"doc_id": F.col("doc_id")})
    wrong = m.proofs().where(merkle.fold(F.sha2(F.lit("x").cast("binary"), 256), F.col("path")) == F.lit(m.root))
    assert wrong.count() == 0


def test_op12(spark):
    assert Counter(map(tuple, QUERIES["op12_merkle"](spark, SF0001).collect())) == Counter(_manifest(table(spark)))
