"""Token counts and piece ids against the libraries."""

import json
import random

import pytest
from fixtures import awkward_texts, empty, table

P = pytest.importorskip("public_tokenizers")


def odd_texts(n=1500):
    rnd = random.Random(2)
    parts = [*"abc eE.,'s▁ \n\t0123é中😀́Σςİ\x00\x1c\u2028\u00a0", "<|endoftext|>", "<|startoftext|>", "'ll", "  ", "aaaa", "thth", "word "]
    return [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 50)))) for i in range(n)] + [(n, "ab" * 2000), (n + 1, "th" * 900)]


def test_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    from platewise.llm.token_counts import count_tokens

    path = P.path("word_bpe_49k.json")
    rows = awkward_texts() + odd_texts()
    lib = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(table(spark, rows), path).collect())
    assert got == want
    assert count_tokens(empty(spark), path).count() == 0


def test_merges_apply_one_at_a_time_where_order_matters():
    from platewise.llm.token_counts import MergeTable, byte_symbols

    symbols = byte_symbols()
    vocab = {s: i for i, s in enumerate(symbols)} | {s + "</w>": 256 + i for i, s in enumerate(symbols)}
    merges = [["ab", "x"], ["a", "b"], ["b", "a"], ["aba", "b"], ["ab", "ab"], ["x", "x</w>"]]
    for a, b in merges:
        vocab.setdefault(a, len(vocab))
        vocab.setdefault(b, len(vocab))
        vocab.setdefault(a + b, len(vocab))
    m = MergeTable({"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}})
    rank = {(a, b): i for i, (a, b) in enumerate(merges)}

    def plain(word):
        row = list(word[:-1]) + [word[-1] + "</w>"]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(row, row[1:], strict=False)) if p in rank), default=None)
            if best is None:
                return len(row)
            i = best[1]
            row[i:i + 2] = [row[i] + row[i + 1]]

    rnd = random.Random(4)
    wordlist = ["".join(rnd.choices("abx", k=rnd.randint(1, 14))) for _ in range(800)]
    assert m.lengths([w.encode() for w in wordlist]).tolist() == [plain(w) for w in wordlist]


def test_pieces_are_the_library_s_and_decode(spark):
    import sentencepiece

    from platewise.llm.pieces import MARK, decode_pieces, encode_pieces, load_vocabulary

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = load_vocabulary(path)
    rows = awkward_texts() + odd_texts()
    coded = encode_pieces(table(spark, rows), vocabulary)
    got = coded.collect()
    want = sorted((str(i), lib.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.pieces) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in got)
    back = decode_pieces(coded, vocabulary).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), (t or "").replace(MARK, " ")) for i, t in rows)
    assert encode_pieces(empty(spark), vocabulary).count() == 0


def test_unigram_viterbi_is_the_library_s(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    from platewise.llm.pieces import PieceCoder, load_vocabulary

    model = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces as a unigram model
    rnd = random.Random(9)
    for p in model.pieces:
        if p.type == 1:
            p.score = -rnd.uniform(3, 14) - 0.5
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    coder = PieceCoder(load_vocabulary(str(tmp_path / "u.model")))
    assert not coder.bpe
    texts = [" ".join(rnd.choices(["the", "theatre", "thereafter", "unigram", "Zürich", "a", "aaa", "x1"], k=12)) for _ in range(300)]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        score = lambda x: sum(lib.get_score(int(i)) for i in x)
        assert abs(score(ids) - score(lib.encode(t))) < 1e-3 and coder.decode(ids.tolist()) == t


def test_tokenizer_file_of_another_kind_is_refused(spark):
    from platewise.llm.token_counts import TokenCounter

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]
    with pytest.raises(ValueError):
        TokenCounter(spec)
