import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library

from askgrid.llm import packing
from askgrid.llm import sentencepiece as sp
from tests.llm.conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sp.load(MODEL)


def test_encoding_equals_the_library(spark, odd, docs, model):
    theirs = library.SentencePieceProcessor(model_file=MODEL)
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in both.collect())
    encoded = sp.encode_documents(both, model)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids or [])) for r in encoded.collect())
    assert got == sorted((a, b, theirs.encode(t)) for a, b, t in texts)
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in sp.decode_documents(encoded, model).collect())
    assert back == texts


def test_digests_do_not_depend_on_what_is_broadcast(odd, model):
    few, all_ = (sorted(map(tuple, sp.encode_digests(odd, model, frequent=n).collect()), key=str) for n in (2, 100000))
    assert few == all_ and len(few) == len(ODD) and all(r[3] for r in few)


def test_digests_are_of_the_librarys_ids_and_texts(spark, odd, docs, model):
    theirs = library.SentencePieceProcessor(model_file=MODEL)
    metas = spark.createDataFrame([(20, "a▁b"), (21, " two  spaces "), (21, " two  spaces "), (22, "▁")], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(metas)
    wanted = [(r.doc_id, r.text, ids := theirs.encode(r.text or ""), r.text is None or theirs.decode(ids) == r.text) for r in both.collect()]
    wanted = spark.createDataFrame([(a, None if t is None else ids, back) for a, t, ids, back in wanted], "doc_id long, ids array<int>, back boolean")
    wanted = wanted.selectExpr("doc_id", "coalesce(array_size(ids), 0)", "xxhash64(ids)", "back").collect()
    for frequent in (0, 300, 100000):
        got = sp.encode_digests(both, model, frequent=frequent).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, wanted)))
    assert {r.doc_id for r in got if not r.round_trip} == {20, 22}


def test_long_words_merge_alike(model):
    theirs = library.SentencePieceProcessor(model_file=MODEL)
    ranks = {t: (i, s) for i, (t, s, k) in enumerate(model.pieces) if k == sp.NORMAL}
    random.seed(3)
    for _ in range(300):
        word = "".join(random.choice("aabehlnort-=é") for _ in range(random.randint(1, 90)))
        assert sp.merge_word(sp.META + word, ranks, model.byte_ids, 0) == theirs.encode(word)


def test_viterbi_fold_finds_the_best_path(spark):
    pieces = [("<unk>", 0.0, sp.UNKNOWN), *[(p, s, sp.NORMAL) for p, s in (("a", -1.0), ("b", -1.5), ("ab", -2.0), ("ba", -1.2), ("aba", -2.9), (sp.META, -0.5), (sp.META + "a", -1.1))]]
    model = sp.Model(tuple(pieces), sp.UNIGRAM, True)
    score = {t: (i, s) for i, (t, s, k) in enumerate(pieces) if k == sp.NORMAL}

    def best(word):
        table = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for b in range(e):
                if table[b] and word[b:e] in score:
                    i, s = score[word[b:e]]
                    if table[e] is None or table[b][0] + s > table[e][0] + 1e-12:
                        table[e] = (table[b][0] + s, table[b][1] + [i])
        return table[-1]

    words = [sp.META + w for w in ("", "a", "ab", "aba", "baba", "abbaab", "aabbaababa")]
    got = {r.word: list(r.ids) for r in sp.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    by_id = {i: s for i, s in score.values()}
    for w in words:
        assert abs(sum(by_id[i] for i in got[w]) - best(w)[0]) < 1e-9 and "".join(pieces[i][0] for i in got[w]) == w


def test_empty_tables(none, model):
    assert sp.encode_digests(none, model).count() == sp.encode_documents(none, model).count() == packing.pack_documents(none).count() == 0


def test_packing_places_every_piece(odd, docs):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    wanted = []
    for r in both.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(head, len(ids) + 1, 2048)] if len(ids) > head else [0, len(ids)]
        wanted += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for group in (40, 20_000):
        got = packing.pack(packing.pieces(both), group=group).collect()
        assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, wanted))
        fill = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert fill.get(r.sequence_id, 0) == r.offset
            fill[r.sequence_id] = r.offset + r.length
        assert max(fill.values()) <= 2048
    lengths = np.array([r.length for r in got])
    assert len(fill) <= packing.lower_bound(lengths, 2048) + 1


def test_bounds_never_pass_the_optimum():
    random.seed(1)

    def optimum(items, capacity):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in sorted({b: i for i, b in enumerate(bins)}.values()):
                if bins[i] + items[k] <= capacity:
                    bins[i] += items[k]
                    place(k + 1, bins)
                    bins[i] -= items[k]
            place(k + 1, bins + [items[k]])

        place(0, [])
        return best

    for _ in range(120):
        items = sorted((random.randint(1, 20) for _ in range(random.randint(1, 8))), reverse=True)
        exact = optimum(items, 20)
        bins, offsets, made = packing.best_fit_decreasing(np.array(items), 20)
        assert packing.lower_bound(np.array(items), 20) <= exact <= made
        assert max(o + n for o, n in zip(offsets, items)) <= 20


def test_a_row_repeated_many_times_is_dealt_to_all_groups(spark):
    items = spark.range(6000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "1000L AS length", "5L AS ids_crc32")
    got = packing.pack(items, group=1000)
    assert got.count() == 6000 and got.select("sequence_id").distinct().count() == 3000
