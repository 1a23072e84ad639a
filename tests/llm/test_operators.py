import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlane.llm import bytededup, chat, decontaminate, langid, linededup, packing, quality, seedextend, simhash, tokens, urls, worddedup
from emberlane.llm.components import connected_components
from emberlane.llm.queries import held_out, tokenizer_json
from tests.llm import reference as ref

SCHEMA = "doc_id long, text string, lang string, row string, score double, kept boolean, n_words long, fp long"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnop") + r.choice(("an", "the", "ion", "é", "x")) * r.randint(1, 3) + str(r.randint(0, vocabulary) % 7) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(k, 120) for k in range(12)]
    passage = prose(99, 60)
    texts = [
        *base,
        base[0],
        base[0],
        base[1] + "\n" + passage,
        passage + "\n" + base[2],
        "\n".join([base[3][:200], base[4][:200], base[5][:200]]),
        "\n".join(["Title", base[3][:200], base[4][:200], "End of it"]),
        base[6].replace("a", "A", 1),
        "word " * 60,
        "aaaaaaaaaa" * 30,
        "aaaaaaaaaa" * 31,
        prose(7, 3000) + "\n" + passage,
        None,
        "",
        " \t\n ",
        "two words",
        "ÉTÉ　née\xa0là # * $ %",
        "x",
    ]
    out = list(enumerate(texts))
    return [*out, out[3], out[3], (3, base[8]), (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", "r", 1.0, True, 5, 6) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("hot_items", [1 << 16, 2, 0])
def test_bytes_match_brute_force(docs, rows, hot_items):
    raw = [(t or "").encode() for _, t in rows]
    flags = ref.covered(raw, ref.ids_of(rows), 50)
    got = bytededup.dedup_bytes(docs, block_bytes=3000, target_bytes=4000, hot_items=hot_items).select("doc_id", "n_bytes", F.md5("kept"), F.size("spans")).collect()
    spans = [sum(1 for k, c in enumerate(f) if c and (k == 0 or not f[k - 1])) for f in flags]
    same(got, [(i, len(b), hashlib.md5(bytes(x for x, c in zip(b, f) if not c)).hexdigest(), n) for (i, _), b, f, n in zip(rows, raw, flags, spans)])


@pytest.mark.parametrize("hot_items", [1 << 16, 2, 0])
def test_words_match_brute_force(docs, rows, hot_items):
    raw = [ref.WORD.findall(t or "") for _, t in rows]
    flags = ref.covered(raw, ref.ids_of(rows), 13)
    got = worddedup.dedup_words(docs, block_bytes=3000, target_bytes=4000, hot_items=hot_items).select("doc_id", "n_words", "n_removed", "kept").collect()
    same(got, [(i, len(w), sum(f), " ".join(x for x, c in zip(w, f) if not c)) for (i, _), w, f in zip(rows, raw, flags)])


def test_lines_match_brute_force(docs, rows):
    got = linededup.dedup_lines(docs).select("row.doc_id", "kept_text", "n_removed").collect()
    same(got, [(i, t, n) for (i, _), (t, n, _) in zip(rows, ref.dedup_lines(rows))])


def test_line_runs_of_any_depth(spark):
    run = "\n".join(f"line {k}" for k in range(21))
    out = linededup.dedup_lines(spark.createDataFrame([(1, run), (2, "head\n" + run + "\ntail"), (3, "other")], "doc_id long, text string")).orderBy("row.doc_id").collect()
    assert [r.kept_text for r in out] == [run, "head\ntail", "other"] and [[tuple(x) for x in r.runs] for r in out] == [[], [(1, 21)], []]


@pytest.mark.parametrize("min_words", [5, 8, 13])
def test_short_lines_need_deep_rounds(spark, min_words):
    r = random.Random(min_words)
    phrases = [[" ".join(r.choices("abcdefg", k=r.choice((1, 1, 1, 2, 3)))) for _ in range(r.randint(2, 12))] for _ in range(12)]
    rows = [(k, "\n".join(x for p in r.choices(phrases, k=4) for x in (*p[: r.randint(1, len(p))], *r.choices(["q%d" % k, "", " "], k=1)))) for k in range(60)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=min_words).select("row.doc_id", "kept_text", "n_removed", "runs").collect()
    want = ref.dedup_lines(rows, min_words)
    assert max(n for w in want for _, n in w[2]) > 4  # shallow rounds alone would leave these
    same([(r.doc_id, r.kept_text, r.n_removed, [tuple(x) for x in r.runs]) for r in got], [(i, t, n, x) for (i, _), (t, n, x) in zip(rows, want)])


def test_simhash_matches_brute_force(docs, rows):
    prints = [ref.fingerprint(t) for _, t in rows]
    comp = ref.components([i for i, _ in rows], prints)
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    same([(r[0], r[1] % (1 << 64), r[2]) for r in got], [(i, p, c) for (i, _), p, c in zip(rows, prints, comp)])


@pytest.mark.parametrize("most", [4096, 2])
def test_pigeonring_links_all_within_three_bits(spark, most):
    """With ``most`` = 2 nearly every key is hot and goes through the finer ones."""
    r = random.Random(3)
    centre = [r.getrandbits(64) for _ in range(20)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = connected_components(simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), most=most)).collect()
    want = ref.components(list(range(len(prints))), prints)
    got = {n: c for n, c in found}
    label = [got.get(p, p) for p in signed]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_null_ids_link(spark, monkeypatch):
    prints = [(0, 1, 10), (7, None, 11), (63, 3, 12), (0x0FFF << 20, None, 13), (0x1FFF << 20, None, 14)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: spark.createDataFrame([(i, t, f) for f, i, t in prints], "doc_id long, text_key long, fp long"))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(None).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (3, 63): 1, (None, 0x0FFF << 20): None, (None, 0x1FFF << 20): None}


def test_one_row_of_each_group_stays(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(5, a), (5, a), (7, a), (None, a), (9, b), (9, b), (None, None), (None, ""), (4, prose(3, 50))]
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], "doc_id long, text string, fp string, text_key string").repartition(3)
    got = [(x.doc_id, x.text or "") for x in simhash.drop_near_duplicates(df).select("doc_id", "text").collect()]
    same(got, [(5, a), (9, b), (None, ""), (4, prose(3, 50))])


def test_fingerprints_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "_PART", 100)
    monkeypatch.setattr(simhash, "_HASHES", 50)
    texts = [prose(1, 500), "x" * 1000, "a " + "y" * 500 + " b", " " * 400, " \n".join("abc" * 300)]
    for n in (1, 3, 5):
        whole = [simhash._fingerprints([t.encode()], n)[0] for t in texts]
        monkeypatch.setattr(simhash, "_PART", 1 << 20)
        assert whole == [simhash._fingerprints([t.encode()], n)[0] for t in texts]
        monkeypatch.setattr(simhash, "_PART", 100)
    monkeypatch.setattr(simhash, "_PART", 100)
    assert [int(x) for x in simhash._fingerprints([t.encode() for t in texts], 3)] == [ref.fingerprint(t) for t in texts]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = dict(connected_components(links).collect())
    assert got[60] == 0 and got[101] == 100 and len(got) == 61  # the smallest node of each is its own


def test_quality_signals_match_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)] + [(8, 0, 1), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels, buckets=512).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(i, *ref.quality(t)) for i, t in rows])
    kept = quality.keep_quality(docs, labels, buckets=512)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {i for i, t in rows if not ref.quality(t)[5]}


@pytest.mark.parametrize("position", [3, 1 << 62 | 63, (1 << 62) - 1 + (1 << 62)])
def test_windows_are_told_apart_whatever_fits_a_long(spark, monkeypatch, position):
    """Few bits for positions: whole hashes are sorted. Few for hashes: different ones have equal heads and lie between equal ones."""
    monkeypatch.setattr(quality, "_POSITION", position)
    r = random.Random(2)
    part = [" ".join(f"w{r.randint(0, 50)}" for _ in range(9)) for _ in range(6)]
    texts = [" ".join(r.choices(part, k=6)) for _ in range(30)] + ["a " * 30, part[0], ""]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels, buckets=64).select("row.doc_id", "n_repeat_words").collect()
    same(got, [(k, ref.quality(t)[4]) for k, t in enumerate(texts)])


def test_quality_score_is_the_mean_log_ratio(spark):
    texts = [(1, "good words here"), (2, "bad words there now"), (3, "x")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    import xxhash

    def grams(t):
        one = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in t.split()]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(one, one[1:])]
        return [((h - (1 << 64) if h >> 63 else h) % 64) for h in one + two]

    raw, target = np.zeros(64), np.zeros(64)
    for i, t in texts:
        for g in grams(t):
            raw[g] += 1
            target[g] += i == 1
    weight = np.log((target + 2) / (raw * target.sum() / raw.sum() + 2))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels, buckets=64, prior=2.0).select("row.doc_id", "score").collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(np.mean([weight[g] for g in grams(t)]))


def test_packing_round_trip(docs, rows):
    encoder = tokens.PieceEncoder(tokenizer_json())
    got = packing.pack_documents(docs, tokenizer_json(), capacity=256).collect()
    want = []
    for i, t in rows:
        want.append((i, [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]))
    pieces = sorted((str(r.doc_id), r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    by_size = {}
    for i, ids in want:
        by_size.setdefault((str(i), len(ids)), []).append(ids)
    for key, lists in by_size.items():
        mine = [p for p in pieces if p[:2] == key]
        assert sum(p[3] for p in mine) == sum(map(len, lists))
        for _, _, s, n, crc in mine:
            assert crc in {zlib.crc32(np.array(x[s : s + n], dtype="<u4").tobytes()) for x in lists}
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256 and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    r = random.Random(4)
    p = packing.Packer(16, 0, 1 << 20)
    for k in range(400):
        n = r.randint(1, 15)
        before = {h: len(v) for h, v in p.open.items() if v}

        def squares(h, n=n, before=before):
            now = dict(before)
            if h:
                now[h] -= 1
            if h + n < 16:
                now[h + n] = now.get(h + n, 0) + 1
            return sum(v * v for v in now.values())

        choices = {h: squares(h) for h in (0, *before) if h + n <= 16}
        chosen = p.best(n)
        assert choices[chosen] == min(choices.values()) and chosen == max(h for h, v in choices.items() if v == min(choices.values()))
        p.place((k, 0, np.zeros(n, "<u4"), n))
        assert p.level[1:16].sum() == p.n_open == sum(len(v) for v in p.open.values()) and p.held == sum(h * len(v) for h, v in p.open.items())


def test_pieces_equal_the_tokenizer():
    encoder = tokens.PieceEncoder(tokenizer_json())
    texts = ["don't he'll x.y a…b «été», 12km² ABC　d\x0be", "<|endoftext|> in text", "", None, "İstanbul ΣΑΣ é!? ..'s 's", "naïve–dash éa 3.14 $$%a&b", prose(1, 50)]
    ids, sizes = encoder.encode(pa.array(texts))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for t, s, e in zip(texts, upto, upto[1:]):
        assert ids[s:e].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
        one, _ = encoder.encode(pa.array([t], pa.string()))
        assert one.tolist() == ids[s:e].tolist()


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    assert tokens.PieceEncoder(tokenizer_json()).exact
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens.PieceEncoder(f.read())
    texts = ["Mixed CASE  text", "it's é 12", "", "x" * 50]
    ids, sizes = encoder.encode(pa.array(texts))
    assert not encoder.exact and ids.tolist() == [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids] and sizes.sum() == len(ids)


def test_masks_hit_every_tolerated_window():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(all(m[i] == "0" or s + i not in gone for i in range(len(m))) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - len(m) + 1))


def test_masks_of_short_items_hit_them_whatever_differs():
    for n in range(1, decontaminate.WINDOW):
        masks = [set(m) for _, m, length in decontaminate.all_masks(1) if length == n]
        k = decontaminate.tolerance(n)
        assert all(any(m.isdisjoint(gone) for m in masks) for gone in itertools.combinations(range(n), k)) and all(masks)
    assert [decontaminate.tolerance(n) for n in (1, 4, 5, 8, 9, 12, 13, 99)] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert len({salt for salt, _, _ in decontaminate.all_masks(1)}) == len(decontaminate.all_masks(1))


@pytest.mark.parametrize("bits", [16, 20, 23])
def test_bitmap_marks_what_occurs(spark, bits):
    r = random.Random(bits)
    found = {r.getrandbits(64) for _ in range(3000)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in found], "seed long")
    marks = np.unpackbits(decontaminate._bitmap(df, bits), bitorder="little")
    assert len(marks) == 1 << bits and set(np.flatnonzero(marks).tolist()) == {x >> (64 - bits) for x in found}


def test_decontamination(spark, docs, none):
    items = [f"{a}q" for a in prose(5, 40).split()]
    bench = spark.createDataFrame([(1, " ".join(items)), (2, " ".join(items[:9]) + "z"), (3, "too short"), (4, None), (None, " ".join(items[20:35]))], "item_id long, text string")
    near = items[5:25]
    near[3], near[9] = "other", "words"
    far = [w if k % 3 else "no" for k, w in enumerate(items[5:25])]
    more = [(501, "pre, " + " ".join(near).upper() + "! post"), (502, " ".join(far)), (503, " ".join(items[:8]) + " " + items[8] + "z"), (504, " ".join(items[22:35]))]
    got = {r.doc_id: r for r in decontaminate.find_overlaps(docs.select("doc_id", "text", F.lit(1).alias("items"), F.lit("x").alias("item_id"), F.lit(2).alias("text_key")).union(spark.createDataFrame([(*m, 1, "x", 2) for m in more], "doc_id long, text string, items int, item_id string, text_key int")), bench).collect()}
    assert got[501]["items"] == [1] and got[501].n_tokens == 20 and got[501].spans[0].start == 1
    assert got[502]["items"] == [] and got[503]["items"] == [2] and got[504]["items"] == [None, 1]
    assert not any(r["items"] for i, r in got.items() if i is None or i < 500)
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()
    assert all(not r["items"] for r in decontaminate.find_overlaps(docs, bench.where("false")).collect())


@pytest.mark.parametrize("shortest", [8, 1])
@pytest.mark.parametrize("block_tokens", [decontaminate.BLOCK_TOKENS, 0])
def test_overlaps_match_brute_force(spark, block_tokens, shortest):
    """Looked up in one block, and joined as a benchmark of any size is."""
    r = random.Random(8)
    word = lambda n: "w%d" % r.randint(0, n)
    items = [[word(400) for _ in range(n)] for n in (40, 25, 13, 14, 9, 8, 12, 5, 1)] + [["w1"] * 20, ["w1", "w2"] * 9]
    texts = []
    for k in range(40):
        t = [word(400) for _ in range(r.randint(0, 30))]
        if k % 2:
            item = r.choice(items)
            s = r.randint(0, len(item) // 2)
            part = list(item[s : s + r.randint(5, 40)])
            for _ in range(r.randint(0, 5)):
                part[r.randrange(len(part))] = word(400)
            t += part + [word(400) for _ in range(r.randint(0, 9))]
        texts.append(t)
    for item in items[2:8] * 4:  # short items with some tokens replaced
        part = list(item)
        for _ in range(r.randint(0, 3)):
            part[r.randrange(len(part))] = word(400)
        texts.append([word(400) for _ in range(r.randint(0, 3))] + part + [word(400) for _ in range(r.randint(0, 3))])
    texts += [["w1"] * 60, ["w2", "w1"] * 30, []]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(items[0])), (3, " ".join(texts[3])), (3, " ".join(items[1])), (77, None)]
    df = spark.createDataFrame([(*x, "l") for x in rows], "doc_id long, text string, item string").repartition(3)
    bench = spark.createDataFrame([*((k, " ".join(t)) for k, t in enumerate(items)), (0, " ".join(items[0])), (None, " ".join(items[2])), (50, None)], "item_id long, text string")
    got = decontaminate.find_overlaps(df, bench, shortest=shortest, block_tokens=block_tokens).collect()
    want = []
    for i, t in rows:
        found = {k: ref.overlaps((t or "").split(), x, shortest=shortest) for k, x in [*enumerate(items), (None, items[2])]}
        names = sorted((k for k, v in found.items() if v), key=lambda k: (k is not None, k))
        want.append((i, names, len(set().union(*found.values()))))
    same([(x.doc_id, x["items"], x.n_tokens) for x in got], want)
    assert sum(bool(w[1]) for w in want) > 10
    kept = decontaminate.drop_contaminated(df, bench, shortest=shortest, block_tokens=block_tokens).select("doc_id", "text").collect()
    same(kept, [x for x, w in zip(rows, want) if not w[1]])


def test_repetitive_texts_do_not_multiply():
    import time

    block = decontaminate.Block([1], [" ".join(["same"] * 2000)], 8)
    h, _, _, first = decontaminate.tokens(pa.array([" ".join(["same"] * 20000)]))
    began = time.time()
    assert block.overlaps(h, first) == [(0, 0, 0, 20000)] and time.time() - began < 10


def test_language_model_equals_the_dense_computation():
    r = random.Random(6)
    parts = {"aa": "tion the and of ing", "bb": "über ein ich sch keit", "cc": "que les eau ment été"}
    texts, langs = zip(*((" ".join("".join(r.choices(parts[x].split(), k=2)) for _ in range(8)), x) for x in sorted(parts) for _ in range(12)))
    texts = [*texts, "12"]
    langs = [*langs, "cc"]

    def grams(t):
        b = t.encode().lower()
        return {b[k : k + n] for n in (1, 2, 3) for k in range(len(b) - n + 1)}

    known = set().union(*map(grams, texts))
    kernel = lambda a, b: len(grams(a) & grams(b) & known) / np.sqrt(len(grams(a) & known) * len(grams(b) & known))
    marks = [t for x in sorted(parts) for t in [t for t, y in zip(texts, langs) if y == x][:5]]
    k = np.array([[kernel(a, b) for b in marks] for a in texts])
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = k @ root
    target = np.array([[1.0 if y == x else -1.0 for x in sorted(parts)] for y in langs])
    weight = np.diag([1 / langs.count(y) for y in langs])
    w = np.linalg.solve(phi.T @ weight @ phi + 1e-2 * np.eye(phi.shape[1]), phi.T @ weight @ target)
    new = ["the andtion x", "über q", texts[3]]
    want = np.array([[kernel(a, b) for b in marks] for a in new]) @ root @ w
    model = langid.fit(texts, langs, 5, 1e-2)
    best, score = model.score(pa.array(new), model.column())
    assert best.tolist() == want.argmax(axis=1).tolist() and np.allclose(score, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)


def test_language_id(spark, docs, none):
    words = {"aa": "tion the and of ing", "bb": "über ein ich sch keit", "cc": "que les eau ment été"}
    rows = []
    for k in range(300):
        lang = sorted(words)[k % 3]
        r = random.Random(k)
        rows.append((k, " ".join("".join(r.choices(words[lang].split(), k=2)) for _ in range(15)), lang))
    df = spark.createDataFrame([*rows, (900, "12 34", "aa"), (901, None, None), (None, "tion the and", None)], "doc_id long, text string, lang string")
    got = langid.identify_languages(df, held_out(), per_lang=60, landmarks=10).collect()
    assert len(got) == 303
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([sorted(words)[r.doc_id % 3] == r.lang_pred for r in held]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"und"}
    assert {r.lang_pred for r in langid.identify_languages(df.withColumn("lang", F.lit(None).cast("string")), held_out()).collect()} == {"und"}


def test_urls(spark):
    cases = [
        (1, "http://A.Example.net/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://x.net/", "x.net", "/", "net/", "block"),
        (3, "https://x.net", "x.net", "", None, "allow"),
        (4, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (5, "https://example.com/de/7#q", "example.com", "/de/7", "example.com/de/", "block"),
        (6, "https://m.casino-win.example.com/en/", "m.casino-win.example.com", "/en/", None, "block"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme/net/", "", "", None, "allow"),
        (9, "http://b.org/fr/a?http://net/", "b.org", "/fr/a", "org/fr/", "allow"),
        (None, "ftp://net?x/", "net", "", None, "allow"),
    ]
    df = spark.createDataFrame([(c[0], c[1], "h") for c in cases] + [(1, cases[0][1], "h")], "page_id long, url string, host string")
    same(urls.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect(), [(c[0], *c[2:]) for c in cases] + [(1, *cases[0][2:])])


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "one"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", "less"), (2, 0, None, "<|im_end|>"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.digests(chat.format_preferences(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 1)).collect()}
    assert got[0].n_prefix_turns == 2 and got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\none<|im_end|>\n"
    assert got[0].chosen.startswith("<|im_start|>user\nmore") and got[0].chosen_mask == "0:17 0:14 0:1 0:22 1:13 0:1" and got[0].rejected_mask == "0:17 0:14 0:1"
    assert got[1].status == "unpaired" and got[1].chosen == "<|im_start|>user\n< |im_end|><|im_end|>\n" and got[1].rejected == ""
    assert got[2].status == "identical" and got[2].chosen == "" and None in got


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        bytededup.dedup_bytes(none), worddedup.dedup_words(none), linededup.dedup_lines(none), simhash.near_duplicates(none), quality.score_quality(none, labels, buckets=64),
        packing.pack_documents(none, tokenizer_json()), decontaminate.find_overlaps(none, bench), langid.identify_languages(none, held_out()), urls.filter_urls(spark.createDataFrame([], "page_id long, url string")),
        chat.digests(chat.format_preferences(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), F.col("conv_id"), F.lit(False))),
    ):
        assert out.count() == 0


def test_targets_are_even_ranges_of_hashes():
    r = np.random.default_rng(4)
    for bits, targets in ((48, 1), (48, 7), (64, 1000), (48, 10_000_000)):
        h = np.sort(r.integers(0, 1 << bits, 5000, dtype=np.uint64))
        names, cut = seedextend.target_runs(h, targets, bits)
        assert cut[0] == 0 and cut[-1] == len(h) and (np.diff(names) > 0).all() and names[-1] < targets
        for t, s, e in zip(names.tolist(), cut[:-1], cut[1:]):
            assert all(t == ((int(x) >> (bits - 32)) * targets) >> 32 for x in h[s:e])
    assert [len(x) for x in seedextend.target_runs(np.zeros(0, np.uint64), 5)] == [0, 1]


def swapped(rows):
    """format_swapped by the definition: (pair_id, chosen, rejected) turns of (conv_id, turn, role, text) rows."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "user", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}

    def answer(turns):
        return max((k for k, t in enumerate(turns) if t[0] == "assistant"), default=len(turns))

    out = {}
    for c, mine in convs.items():
        other = convs.get(c + 1 if c % 2 == 0 else c - 1, [])
        out[c] = (mine, mine[: answer(mine)] + other[answer(other) :])
    return out


def test_swapped_pairs(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(("user", "assistant", None)), r.choice(("hi", "yo", None, "", "a b"))) for c in (*range(-6, 7), 40, 43) for t in range(r.randint(1, 5))]
    rows += [(-1, 90, "assistant", "neg"), (1, 90, "assistant", "one"), (50, 1, "user", "long " * 60_000), (51, 1, "user", "tie"), (51, 1, "user", "tie")]
    df = spark.createDataFrame([(*x, 1, "r", True) for x in rows], "conv_id long, turn long, role string, text string, pair_id int, prompt string, rejected boolean").repartition(3)
    got = {x["pair_id"]: x for x in chat.format_swapped(df).collect()}
    want = swapped(rows)
    assert set(got) == set(want) and {-1, 0, 1} <= set(got)
    text = lambda turns: "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns)
    for c, (chosen, rejected) in want.items():
        k = next((k for k, (a, b) in enumerate(itertools.zip_longest(chosen, rejected)) if a != b), len(chosen))
        x = got[c]
        assert x["prompt"] == text(chosen[:k]) and "".join(s["text"] for s in x["chosen"]) == text(chosen[k:]) and "".join(s["text"] for s in x["rejected"]) == text(rejected[k:])


def test_very_long_texts_and_ties_of_languages(spark):
    rows = [(k, f"{w} words of one kind {k % 7}", lang) for k, (w, lang) in enumerate(itertools.product(("alpha beta", "gamma delta"), ("bb", "aa", "bb", "aa")))]
    rows = [(k, t.split(" words")[0] + " same text", lang) for k, t, lang in rows]  # both languages learn from equal texts
    rows += [(100, "alpha beta same text " * 20_000, None), (101, "alpha beta same text", None), (101, "alpha beta same text", None), (102, "1 2 3 " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {}
    for x in langid.identify_languages(df, F.col("doc_id") >= 100).collect():
        got.setdefault(x.doc_id, []).append((x.lang_pred, round(x.score, 6)))
    assert {p for k, v in got.items() if k != 102 for p, _ in v} == {"aa"}  # of equals the first by name
    assert len(got[101]) == 2 and got[101][0] == got[101][1] and got[102] == [("und", 0.0)]


def test_very_long_and_repeated_urls(spark):
    long = "https://a.example.net/en/" + "x" * 300_000 + "?q=" + "y" * 100_000
    rows = [(1, long), (2, "http://" + "sub." * 20_000 + "net/" + "p" * 10), (3, "https://example.com/de/a"), (3, "https://example.com/de/a"), (4, "https://EXAMPLE.com/de"), (5, "x" * 200_000)]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, host string").repartition(2)
    got = sorted((x.page_id, x.rule, x.verdict, len(x.path)) for x in urls.filter_urls(df).collect())
    assert got[0] == (1, "example.net/en/", "allow", 300_004) and got[1][:3] == (2, "net/", "block")
    assert got[2] == got[3] == (3, "example.com/de/", "block", 5) and got[4][1] is None and got[5] == (5, None, got[5][2], 0)
