import itertools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from plumbline.llm.packing import best_fit, pack, plan_sequences, reduce_instance
from plumbline.llm.tokens import WordTokenizer, default_path


def fewest(items, capacity):
    """Exact number of bins by branch and bound over a small list."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += items[i]
                place(i + 1, rest)
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        items = [rng.randint(2, 20) for _ in range(rng.randint(1, 9))]
        counts = {v: items.count(v) for v in items}
        fixed, left = reduce_instance(counts, 20)
        rest = [v for v, n in left.of.items() for _ in range(n)]
        assert sorted(rest + [v for g, n in fixed for v in g * n]) == sorted(items)
        assert all(sum(g) <= 20 for g, _ in fixed)
        assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(1)
    drawn = np.clip(rng.lognormal(6, 1.1, 40000), 2, 4095).astype(int)
    counts = dict(zip(*(x.tolist() for x in np.unique(drawn, return_counts=True)), strict=True)) | {4096: 5, 7: 9000}
    plan = plan_sequences(counts)
    fill, places = {}, set()
    for length, lo, n, base, offset in zip(*(plan[k] for k in ("length", "lo", "n", "base", "offset")), strict=True):
        later = plan["lo"][(plan["length"] == length) & (plan["lo"] > lo)]
        hi = later.min() if len(later) else counts[int(length)]
        for r in range(lo, hi):
            s = int(base + (r - lo) % n)
            at = int(offset + (r - lo) // n * length)
            assert (s, at) not in places
            places.add((s, at))
            fill.setdefault(s, []).append((at, int(length)))
    assert len(places) == sum(counts.values())
    for spans in fill.values():
        end = 0
        for at, length in sorted(spans):
            assert at == end
            end = at + length
        assert end <= 4096
    least = max(-(-sum(k * v for k, v in counts.items()) // 4096), sum(v for k, v in counts.items() if k > 2048))
    assert len(fill) <= least * 1.005 + 2


def test_best_fit_counts_match_items():
    _, left = reduce_instance({5: 7, 4: 3, 3: 1}, 16)
    sets = best_fit(left, 16)
    assert all(sum(v * c for v, c in content) <= 16 for content, _ in sets)


def test_word_cache_equals_the_library():
    texts = [
        "Hello World don't we'll ''' x_y __a #_# 12³½ naïve Ünïcödé ǅ", "", "a b\tc\nd", "<|endoftext|> x", "日本語 text", "é İstanbul ΣΑΣ",
        "x" * 3000, "can'table 'S 'RE'd", "\x1c\x85 y", "##&& a$$$ thouhe$$$,%%% end.", "ſ ŉ ƻ ǀ ª º µ",
    ]
    t = WordTokenizer(default_path())
    library = Tokenizer.from_file(default_path())
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert t.encode(texts) == want


def check_packed(rows, texts, capacity):
    library = Tokenizer.from_file(default_path())
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None)
    want = []
    for i, x in texts:
        ids = np.array([*library.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert pieces == sorted(w for w in want if w[0] is not None)
    assert len(rows) == len(want)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in group:
            assert r.offset == end
            end += r.length
        assert end <= capacity


def test_pack(spark):
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(rng.choice(["alpha", "beta!", "gamma", "Delta", "ünd"], rng.integers(0, 90)))) for i in range(200)]
    texts += [(500, None), (501, ""), (3, texts[3][1]), (None, "alpha"), (502, "word " * 1000)]
    frame = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, length long, rank long")
    check_packed(pack(frame, 128).collect(), texts, 128)
    assert pack(frame.limit(0)).count() == 0
