import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.packing import END, EVEN_PENALTY, WordIds, best_cuts, candidates, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check(df, padding, size=2048):
    rows = df.collect()
    want = sorted(zip([r.doc_id for r in rows], ids_of([r.text for r in rows]), strict=True), key=repr)
    pieces = pack(df, PATH, size=size, with_ids=True).collect()
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    pad = 0
    for parts in by_sequence.values():
        place = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == place
            place += p.length
        assert place <= size
        pad += 0 if place & (place - 1) == 0 else size - place
    total = sum(p.length for p in pieces)
    assert pad <= padding * total + size * df.rdd.getNumPartitions()
    if len({r.doc_id for r in rows}) == len(rows):
        by_doc = {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
        got = []
        for name, parts in by_doc.items():
            parts.sort(key=lambda p: p.start)
            joined = [x for p in parts for x in p.ids]
            assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
            assert {p.doc_tokens for p in parts} == {len(joined)}
            got.append((name, joined))
        assert sorted(got, key=repr) == want
    assert total == sum(len(x) for _, x in want)


def test_documents(docs):
    check(docs, 0.02)
    check(docs.repartition(3), 0.1, size=512)


def test_batches(docs, monkeypatch):
    import quire.llm.packing as packing

    stream, cache = packing.Stream(256, 0), packing.WordIds(PATH, 1)
    rows = docs.limit(60).toArrow()
    total = 0
    for i in range(0, len(rows), 7):
        part = rows.slice(i, 7).combine_chunks()
        stream.add(part["doc_id"].to_pylist(), *packing.encode(part["text"].combine_chunks(), cache))
        total += sum(p[2] for p in stream.pieces(i + 7 >= len(rows)))
    assert total == sum(map(len, ids_of(rows["text"].to_pylist()))) and not len(stream.ids)


def test_odd_rows(odd, none):
    extra = odd.withColumns({"id": F.lit("x"), "start": F.lit(1), "ids": F.lit(None).cast("int")})
    check(extra.where("doc_id is not null and doc_id not in (2, 7)"), 0.05)
    check(extra, 0.05)
    assert pack(none, PATH).count() == 0


def test_ids_of_odd_words():
    import pyarrow as pa

    from quire.llm.packing import WordIds, encode

    texts = [
        "It's. HE'S, we'LL! a.b;c 3.14 1,000 x...y …a. «Été», ÉTÉ. É×. ÷, œuvre, ß! a.) (b?) ...", "<|endoftext|> <|ENDOFTEXT|> A. <|startoftext|>. b", "e\u0301. a\u0301, \u0301. .\u0301 x\u00a0Y.Z\u3000W",
        "", None, "ΣΑΣ. Σ, İ. ǅ!", "a.'s b,'t 's. .'s 'S", "漢字。かな. 한글, \U0001f600. \x00. a\x1cb", "AA.BB,CC;DD:EE!FF?GG", "0.1.2,3a4.b5",
    ]
    ids, sizes, _ = encode(pa.array(texts, pa.string()), WordIds(PATH, 1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ids_of(texts)
    other = public_tokenizers.path("byte_bpe_50k.json")
    ids, sizes, stops = encode(pa.array(texts, pa.string()), WordIds(other, 1))
    t = Tokenizer.from_file(other)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts] and not len(stops)
    every = "".join(map(chr, range(0x20, 0x250)))
    words = [a + c + b for c in every for a, b in (("", ""), ("a", "b"), ("", "."), (".", "é"))]
    ids, sizes, _ = encode(pa.array(words, pa.string()), WordIds(PATH, 1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ids_of(words)


def same_ids(words):
    import pyarrow as pa

    from quire.llm.packing import WordIds, encode

    ids, sizes, _ = encode(pa.array(words, pa.string()), WordIds(PATH, 1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ids_of(words)


def test_ids_of_letters_with_marks():
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    same_ids([a + chr(m) for a in letters for m in range(0x300, 0x370)])
    same_ids(["Y\u030a H\u0331 T\u0308 W\u030a J\u030c T\u0344", "T\u0591\u0308. Y\u1dc0\u030a", "Té. AÉ.B", "I\u0307", "A\u3099"])


def test_ids_of_random_texts():
    rng = random.Random(11)
    signs = [*"ABCHIJTWYZabhijtwyz019.,;:!?'<>|&- \t\n", *map(chr, range(0xC0, 0x250)), *map(chr, range(0x300, 0x370)), *"漢かがΣσς\u0345\u1e97\u1e98\u01f0\u3099\u0591\u1dc0\u212b\u2126\u0130\u0131\ufb01\uac00\u11a8\U0001f600\x00\x1c\u00a0\u2028"]
    weights = [40] * 39 + [1] * (len(signs) - 39)
    same_ids(["".join(rng.choices(signs, weights, k=rng.randint(1, 24))) for _ in range(100_000)])


def cost(cuts, penalty, size):
    total = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = b - a
        if n > size:
            return None
        even = n & (n - 1) == 0 and 512 <= n < size
        total += (min(EVEN_PENALTY, size - n) if even else size - n) + penalty[b]
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(50):
        total = rng.randint(900, 6000)
        docs = np.unique([rng.randint(1, total) for _ in range(4)] + [total])
        sentences = np.unique([rng.randint(1, total) for _ in range(6)] + [min(total, 512), min(total, 1024)])
        places, penalties = candidates(docs, sentences, total)
        penalty = dict(zip(places.tolist(), penalties.tolist(), strict=True))
        best = {0: 0}
        for p in places.tolist()[1:]:  # every earlier place is tried
            best[p] = min(best[q] + cost([q, p], penalty, 2048) for q in places.tolist() if q < p and p - q <= 2048)
        assert cost(best_cuts(places, penalties, 2048, total, True), penalty, 2048) == best[total]


def test_few_words_outlast_a_task():
    cache = WordIds(public_tokenizers.path("word_bpe_49k.json"), END)
    words = [f"word{i} {i * i}x ".encode() for i in range(300)]
    ids = lambda: [flat[a : a + n].tolist() for flat, s, c in [cache.of(words)] for a, n in zip(s, c, strict=True)]
    want = ids()
    for most in (400, 300, 40, 0):
        cache.shrink(most)
        assert len(cache.place) == min(most, 300) and sum(map(len, cache.flat)) == cache.total == 1 + sum(map(len, want[:most]))
        assert ids() == want and cache.flat[0][0] == END
