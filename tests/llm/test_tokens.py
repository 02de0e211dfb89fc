"""Token files and the SentencePiece transducer against the libraries, round trips and brute force."""

import tempfile
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import piece_fst, queries, token_store
from gaugeframe.llm.common import scratch_dir

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", " \n x", "a  b\t\tc   d", "don't I'll 'tis they're'd ''s 's 'S it 's", "x'", "'", "ab1é२三 ¹!?…", "日本語テキスト 😀 x", "​x y", "a   ", "   a",
    "a▁b", "<|endoftext|> <s> <0x0A>", "aaaaaaaaaaaaaaaa b", "def f(x):\n    return x+1   # ok", "zzzz1234567890000000", "= = == === ====", "x" * 3000 + " " + "ab " * 20000, "\x00 c", "퟿ \U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_cuts_give_the_library_ids(library, real_docs):
    texts = ODD + [r.text for r in real_docs.collect()] + [a + b + c for a, b, c in product(["a", " ", "'", "\n", "1", "!"], ["s", " ", "  ", "'re", "ll"], ["x", " ", "", "'d", "　"])]
    got = token_store.ByteTokenizer(BPE).encode(texts)
    assert [g.tolist() for g in got] == library(texts)


MARKED = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> don<|endoftext|>'t  <|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>\n x"]


def test_added_tokens_are_ids_of_their_own(real_docs):
    from tokenizers import AddedToken, Tokenizer

    library, own = Tokenizer.from_file(BPE), token_store.ByteTokenizer(BPE, encode_special_tokens=False)
    texts = ODD + MARKED + [r.text for r in real_docs.collect()]
    assert [g.tolist() for g in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(MARKED[:1])[0].tolist() == [64, 50256, 65]
    for how in ({}, {"lstrip": True, "rstrip": True}, {"single_word": True}):
        path = f"{tempfile.mkdtemp(prefix='spark-')}/t.json"
        library = Tokenizer.from_file(BPE)
        library.add_tokens([AddedToken("end", normalized=False, **how), AddedToken("endo", normalized=False, **how)])
        library.save(path)
        for flag in (False, True):
            library.encode_special_tokens = flag
            texts = ODD + MARKED + ["an end of endoend  endo x", "bend"]
            assert [g.tolist() for g in token_store.ByteTokenizer(path, flag).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_the_query_takes_added_tokens(spark, make_docs):
    from tokenizers import Tokenizer

    folder = tempfile.mkdtemp(prefix="spark-")
    make_docs(MARKED).write.parquet(f"{folder}/documents.parquet")
    ids = [np.array([*e.ids, 2], "<u4") for e in Tokenizer.from_file(BPE).encode_batch(MARKED, add_special_tokens=False)]
    ends = np.cumsum([len(i) for i in ids]).tolist()
    got = sorted(map(tuple, queries.op6_token_files(spark, folder).collect()))
    assert got == [(k, end - len(i), len(i), zlib.crc32(i.tobytes())) for k, (i, end) in enumerate(zip(ids, ends))]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 700, n).astype(np.uint16)
    m = token_store.WaveletMatrix.build(ids)
    m = token_store.WaveletMatrix(m.n, [p.tobytes() for p in m.planes], m.zeros, [r.tobytes() for r in m.ranks])
    assert m.n == n and m.ids().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
    for v in [0, 1, 255, 256, 699, 700, 5000, *ids[:5].tolist()]:
        where = np.flatnonzero(ids == v)
        assert m.count(v) == len(where) and m.count(v, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        assert [m.select(v, k) for k in range(len(where))] == where.tolist()
        with pytest.raises(IndexError):
            m.select(v, len(where))


def test_wide_ids_need_more_planes():
    ids = np.array([70000, 3, 70000, 1 << 20], np.uint32)
    m = token_store.WaveletMatrix.build(ids)
    assert m.ids().tolist() == ids.tolist() and m.select(70000, 1) == 2


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_token_files_hold_every_document(spark, make_docs, real_docs, library, most):
    pairs = [(100_000 + i, t) for i, t in enumerate(ODD)] + [(None, "nothing"), (None, None), (7, "b"), (7, "a"), (7, "a")]
    docs = make_docs(pairs).unionByName(real_docs.where("doc_id != 7").limit(60)).withColumn("start", F.lit(1))
    path = scratch_dir(spark, "t")
    token_store.write_token_files(docs.repartition(5), BPE, path, segment_ids=most)
    got = [tuple(r) for r in token_store.read_documents(spark, path).orderBy("start").collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for (doc, _), ids in zip(rows, library([t for _, t in rows])):
        ids = np.array([*ids, 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    found = sorted(map(tuple, token_store.find_token(spark, path, 64).where("doc_id is not null").collect()))
    assert found == sorted((d, k) for (d, t) in rows if d is not None for k, i in enumerate(library([t])[0]) if i == 64)


def test_empty_table_gives_no_rows(make_docs):
    empty = make_docs(["x"]).where("false")
    assert token_store.token_digests(empty, BPE).count() == 0
    assert piece_fst.piece_digests(empty, PIECES).count() == 0


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return piece_fst.PieceTransducer.from_file(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_shortest_paths_are_the_library_ids(pieces, real_docs):
    own, library = pieces
    texts = ODD + [r.text for r in real_docs.collect()]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == library.encode(t), t
        assert own.decode(ids) == library.decode(ids)
    some = [w for t in texts for w in own.segment.findall(own.normalise(t))[:40] if len(w) < 200]
    assert all(own._shortest(w) == own._only(w) for w in some)
    together = own._together(list(dict.fromkeys(some)))
    assert all(np.frombuffer(together[w], np.int32).tolist() == list(own._only(w)) for w in some)


@pytest.mark.parametrize("rule,collapse,prefix", [("nmt_nfkc", True, True), ("nfkc_cf", False, True), ("nmt_nfkc_cf", True, False), ("identity", True, True)])
def test_compiled_normalisers_are_the_library_ones(real_docs, rule, collapse, prefix):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model, norm = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = model.normalizer_spec
    spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix = norm.normalizer_spec.precompiled_charsmap, collapse, prefix
    path = f"{tempfile.mkdtemp(prefix='spark-')}/m.model"
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    own, library = piece_fst.PieceTransducer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [*ODD, "ＡＢＣ　ﬁ  ㌔ ½ e\u0301 Å ｶﾞ", " \u00a0 \u200b x \u3000", "\u0344a", "ÀÉ STRASSE ß", "\t\n"]
    for t in odd + [r.text for r in real_docs.collect()]:
        assert own.normalise(t) == library.normalize(t), t
        assert own.encode(t).tolist() == library.encode(t), t


def test_acceptor_leaves_one_path(pieces):
    """All splits of short strings: the accepted one is what merging gives."""
    ranks = {p: i for i, p in enumerate(["ab", "bc", "aa", "abc", "cab", "aab", "bcab", "a", "b", "c"])}
    m = piece_fst.PieceTransducer({p: i for p, i in ranks.items()}, list(range(100, 356)), ranks=ranks, dummy_prefix=False)

    def merge(text):
        parts = list(text)
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for n in range(1, 9):
        for t in map("".join, product("abc", repeat=n)):
            want = tuple(ranks[p] for p in merge(t))
            assert m._shortest(t) == m._only(t) == want, t
            assert np.frombuffer(m._together([t])[t], np.int32).tolist() == list(want)


def test_unigram_weights_give_the_lightest_path():
    costs = {"a": 2.0, "b": 2.5, "ab": 3.0, "ba": 3.5, "aba": 5.9, "bb": 4.0, "▁": 1.0, "▁a": 2.2}
    ids = {p: i for i, p in enumerate(costs)}
    m = piece_fst.PieceTransducer(ids, list(range(100, 356)), weights=costs)

    def lightest(t):
        return min((costs[t[:k]] + lightest(t[k:]) for k in range(1, len(t) + 1) if t[:k] in costs), default=0.0 if not t else float("inf"))

    by_id = {i: p for p, i in ids.items()}
    for n in range(1, 7):
        for t in map("".join, product("ab ", repeat=n)):
            got = m.encode(t).tolist()
            assert abs(sum(costs[by_id[i]] for i in got) - lightest(m.normalise(t))) < 1e-9
            # the search of many segments is the one path by path
            for w in m.segment.findall(m.normalise(t)) if m.segment else [m.normalise(t)]:
                assert not w or np.frombuffer(m._together([w])[w], np.int32).tolist() == list(m._shortest(w))
            assert m.decode(got) == t
    assert m.decode(m.encode("aéb").tolist()) == "aéb"


def test_piece_rows(make_docs, pieces):
    own, library = pieces
    docs = make_docs([(1, "né\n  x"), (1, "né\n  x"), (None, "a▁b"), (3, None), (4, "")]).withColumn("ids", F.lit("clash"))
    encoded = piece_fst.encode_pieces(docs, PIECES)
    assert sorted((r.doc_id or 0, r.ids) for r in encoded.collect()) == sorted([(1, library.encode("né\n  x"))] * 2 + [(0, library.encode("a▁b")), (3, []), (4, [])])
    assert sorted(r.text for r in piece_fst.decode_pieces(encoded, PIECES).collect()) == sorted(["né\n  x"] * 2 + ["a b", "", ""])
    checked = piece_fst.encode_pieces(docs, PIECES, checked=True)
    assert sorted((r.doc_id or 0, r.ids, r.round_trip) for r in checked.collect()) == sorted((r.doc_id or 0, r.ids, r.doc_id is not None) for r in encoded.collect())
    rows = {r.doc_id: r for r in piece_fst.piece_digests(docs, PIECES).collect()}
    assert rows[1].round_trip and rows[4].round_trip and rows[3].n_ids == 0 and not rows[None].round_trip


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizer_files_are_refused(tmp_path, change):
    import json

    told = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    (tmp_path / "other.json").write_text(json.dumps(told | change), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level"):
        token_store.ByteTokenizer(str(tmp_path / "other.json"))
