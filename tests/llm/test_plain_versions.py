"""Whole queries of the subpackage against plain versions of their methods."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parley.llm import langid, mixing, quality, registry, toxicity
from parley.llm.bytewords import chunks

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def words(text):
    return len((text or "").encode().split())


def test_op2_against_bisection(spark):
    docs = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    rows = {r["doc_id"]: r for r in registry.op2_source_mix(spark, SF).collect()}
    assert rows.keys() == docs.keys() and all(rows[d]["size"] == words(docs[d]["text"]) for d in docs)
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(rows[d]["size"] for d in docs if docs[d]["source"] == s) for s in sources}
    share = {s: w for s, w in zip(sources, np.resize([5.0, 2.0, 1.0], len(sources)))}
    goal, held, total = {}, set(), sum(size.values())
    while True:
        free = total - sum(3 * size[s] for s in held)
        goal = {s: 3.0 * size[s] if s in held else free * share[s] / sum(share[t] for t in sources if t not in held) for s in sources}
        over = {s for s in sources if s not in held and goal[s] > 3 * size[s]}
        if not over:
            break
        held |= over
    for s in sources:
        own = [d for d in docs if docs[d]["source"] == s]
        n = np.array([rows[d]["size"] for d in own], dtype=float)
        scale = max(n.max(), 1)
        lo, hi = -1e3, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            rate = 3 / (1 + 2 * np.exp(-np.clip(mid * n / scale, -500, 500)))
            lo, hi = (lo, mid) if (n * rate).sum() > goal[s] else (mid, hi)
        assert all(math.isclose(rows[d]["target"], goal[s], rel_tol=1e-9) and rows[d]["source_size"] == size[s] for d in own)
        want = plain_copies(n.astype(int), rate if s not in held else np.full(len(n), 3.0), goal[s])
        got = {z: sum(rows[d]["copies"] for d in own if rows[d]["size"] == z) for z in set(n.astype(int).tolist())}
        assert got == want and all(rows[d]["taken"] == rows[d]["copies"] * rows[d]["size"] <= 3 * rows[d]["size"] for d in own)
        assert abs(sum(rows[d]["taken"] for d in own) - goal[s]) <= max(n[n > 0].min(), 0.01 * goal[s])


def plain_copies(sizes, rates, target):
    """Copies of each size: whole parts of running sums from the largest size on, then whole documents for what is left, the largest that fit first."""
    count, copies, upto = {int(z): int((sizes == z).sum()) for z in sizes}, {}, 1 << 19
    for z in sorted(count, reverse=True):
        q = int(np.floor(count[z] * rates[list(sizes).index(z)] * (1 << 20) + 0.5)) if z else 0
        copies[z] = (upto + q) // (1 << 20) - upto // (1 << 20) if z else count[z]
        upto += q
    due = target - sum(z * k for z, k in copies.items())
    for z in sorted((z for z in count if z), reverse=True):
        k = int(min(abs(due) // z, 3 * count[z] - copies[z] if due > 0 else copies[z]))
        copies[z] += k if due > 0 else -k
        due -= k * z if due > 0 else -k * z
    return copies


def test_op7_against_plain_algebra(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    ids, texts = zip(*((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    x = np.concatenate([quality.statistics(c) for c in chunks(pa.array(texts), lower=False)])
    at = {d: i for i, d in enumerate(ids)}
    known = [(r["doc_id"], r["quality"]) for r in labels.filter("quality IS NOT NULL").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    part = {r[0]: r[1] == 0 for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'quality'), 3)").collect()}
    row, y, calibrate = np.array([at[d] for d, _ in known]), np.array([q for _, q in known], dtype=float), np.array([part[d] for d, _ in known])
    mean, dev = x[row].mean(axis=0), x[row].std(axis=0)
    dev[dev <= 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.standard_normal((x.shape[1], quality.COSINES)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.COSINES)
    f = np.hstack([np.cos(np.clip((x - mean) / dev, -8, 8) @ w + b) * np.sqrt(2 / quality.COSINES), np.ones((len(x), 1))])
    a, t = f[row[~calibrate]], y[~calibrate]
    beta = np.linalg.solve(a.T @ a + quality.RIDGE * len(a) / quality.COSINES * np.eye(a.shape[1]), a.T @ t)
    raw = f @ beta
    bins = np.clip(np.floor((raw[row[calibrate]] + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    knots = np.unique(bins)
    blocks = [[k, [y[calibrate][bins == k].mean()] * int((bins == k).sum())] for k in knots]
    level = [np.mean(v) for _, v in blocks]
    weight = [len(v) for _, v in blocks]
    fitted = [max(min(sum(level[i] * weight[i] for i in range(lo, hi + 1)) / sum(weight[lo : hi + 1]) for hi in range(k, len(level))) for lo in range(k + 1)) for k in range(len(level))]
    want = np.interp(raw, (knots + 0.5) / quality.BINS * 2 - 0.5, fitted) * (1 - 1e-6) + 1e-6 * np.clip((raw + 0.5) / 2, 0, 1)
    got = {r["doc_id"]: r["score"] for r in registry.op7_quality(spark, SF).collect()}
    assert got.keys() == at.keys() and np.allclose([got[d] for d in ids], np.clip(want, 0, 1), atol=1e-6)


def test_op8_against_sums_over_segmentations(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    held = {r[0] for r in docs.filter(langid.held_out()).select("doc_id").collect()}
    vocabulary = langid.pieces()
    langs, p = langid.train(docs.filter(~langid.held_out()), vocabulary)
    index = {w: i for i, w in enumerate(vocabulary)}
    longest, seen = max(map(len, vocabulary)), {}

    def total(word):
        if word not in seen:
            a = [np.ones(len(langs))] + [np.zeros(len(langs)) for _ in word]
            for e in range(1, len(word) + 1):
                for s in range(max(0, e - longest), e):
                    if word[s:e] in index:
                        a[e] = a[e] + a[s] * p[index[word[s:e]]]
            seen[word] = np.log(a[-1])
        return seen[word]

    letters = bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
    rows = {r["doc_id"]: r for r in registry.op8_language(spark, SF).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        parts = [x for x in bytes(c if c in letters else 32 for c in low).split() if len(x) <= 60]
        got = rows[r["doc_id"]]
        assert got["held_out"] == (r["doc_id"] in held)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got["lang_pred"] == "und"
        elif len(parts) == len(bytes(c if c in letters else 32 for c in low).split()):
            z = sum(total(b" " + x) for x in parts) / math.sqrt(len(parts))
            share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert langs[int(share.argmax())] == got["lang_pred"] and math.isclose(share.max(), got["score"], abs_tol=1e-6)


def test_training_words_of_any_case_and_length(spark):
    rows = [(i, "Über den ÄRGER sprechen " + "a" * 200, "de") for i in range(3)] + [(i + 3, "about the trouble", "en") for i in range(3)]
    langs, p = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.pieces())
    assert langs == ["de", "en"] and np.allclose(p.sum(axis=0), 1)
    index = {w: i for i, w in enumerate(langid.pieces())}
    # the letter is a piece, with a word's start and without
    upper = [index["Ä".encode()], index[" Ä".encode()]]
    assert p[upper, 0].sum() > 10 * p[upper, 1].sum() and max(map(len, index)) > 8


def read_gif(data):
    """Canvas width, frames of (delay, rows, samples): a reader of its own, straight from the format's description."""
    assert data[:6] == b"GIF89a"
    width, flags, at, frames, delay = int.from_bytes(data[6:8], "little"), data[10], 13, [], 0
    if flags & 0x80:
        at += 3 << ((flags & 7) + 1)

    def blocks(at):
        out = b""
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return out, at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            delay = int.from_bytes(body[1:3], "little") if data[at + 1] == 0xF9 else delay
            at = after
            continue
        w, h = int.from_bytes(data[at + 5 : at + 7], "little"), int.from_bytes(data[at + 7 : at + 9], "little")
        size = data[at + 10]
        stream, at = blocks(at + 11)
        bits, pos, width_, out = int.from_bytes(stream, "little"), 0, size + 1, bytearray()
        clear, end = 1 << size, (1 << size) + 1
        entries, last = [], None
        while True:
            code = bits >> pos & (1 << width_) - 1
            pos += width_
            if code == clear:
                entries, last, width_ = [bytes([i]) for i in range(clear)] + [b"", b""], None, size + 1
                continue
            if code == end:
                break
            now = entries[code] if code < len(entries) else last + last[:1]
            if last is not None and len(entries) < 4096:
                entries.append(last + now[:1])
            out += now
            last = now
            if len(entries) == 1 << width_ and width_ < 12:
                width_ += 1
        assert len(out) == w * h
        frames.append((delay, h, bytes(out)))
    return width, frames


def test_op9_against_another_reader(spark):
    from parley.llm import gif

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, "documents").collect()}
    rows = {r["doc_id"]: r for r in registry.op9_gif_media(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        payload, r = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text)), rows[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for d in sorted(docs, key=lambda d: len(docs[d]))[:: len(docs) // 12]:
        stored = gif.encode(gif.pad(docs[d]))
        width, frames = read_gif(stored)
        r = rows[d]
        assert width == 64 and b"".join(f[2] for f in frames) == gif.pad(docs[d]) and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        colours, canvas = [0] * 8, [(0, 0, 0)] * 0
        palette = [((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85) for i in range(256)]
        canvas = {}
        for _, h, samples in frames:
            canvas.update(enumerate(samples))
            for i in range(64 * frames[0][1]):
                if i in canvas:
                    red, green, blue = palette[canvas[i]]
                    colours[(red >> 7) * 4 + (green >> 7) * 2 + (blue >> 7)] += 1
        assert r["feature"] == f"frames={len(frames)};cs={sum(f[0] for f in frames)};rows={len(gif.pad(docs[d])) // 64};colours={','.join(map(str, colours))}"


def test_op10_fit_is_the_optimum_and_scores_follow(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    found, w, theta = toxicity.train(docs.select("doc_id", "text"), labels)
    at = {int(h): i for i, h in enumerate(found)}
    rows = {r["doc_id"]: r for r in registry.op10_toxicity(spark, SF).collect()}
    eta = {}
    for r in docs.collect():
        (c,) = chunks(pa.array([r["text"]]), 1 << 30)
        counts: dict[int, int] = {}
        for h in toxicity._hashed(c)[0].tolist():
            if h in at:
                counts[at[h]] = counts.get(at[h], 0) + 1
        eta[r["doc_id"]] = sum((1 + math.log(n)) * w[i] for i, n in counts.items())
        above = [1 / (1 + math.exp(-(eta[r["doc_id"]] - t))) for t in theta]
        got = rows[r["doc_id"]]
        assert math.isclose(got["severity"], sum(above), abs_tol=1e-9) and got["toxic"] == (above[0] >= 0.5) and (np.diff(theta) > 0).all()


def test_ordinal_fit_beats_every_small_step():
    rng = np.random.default_rng(12)
    n, k = 300, 5
    x = rng.integers(0, 2, (n, k)).astype(float)
    latent = x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0]) + rng.logistic(size=n)
    grade = np.searchsorted([0.0, 1.0, 2.5], latent)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit(rows, cols, np.ones(len(rows)), grade, k, 4, rounds=4000)

    def loss(w, theta):
        e = x @ w
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(e[:, None] - theta))), np.zeros((n, 1))], axis=1)
        return -np.log(up[np.arange(n), grade] - up[np.arange(n), grade + 1]).sum() + toxicity.RIDGE / 2 * (w**2).sum()

    best = loss(w, theta)
    for i in range(k):
        for d in (-0.05, 0.05):
            assert loss(w + d * np.eye(k)[i], theta) > best - 1e-4
    for i in range(3):
        for d in (-0.05, 0.05):
            assert loss(w, theta + d * np.eye(3)[i]) > best - 1e-4


def shares(df):
    return mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.min("size").alias("least")).collect()


def test_large_and_small_sizes_come_near_the_target(spark):
    sizes = [9000, 8500, 5000, 3, 2, 1, 1, 7]
    df = spark.createDataFrame([(i, "w " * n, "a" if i % 2 else "b") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = {r["source"]: r for r in shares(df)}
    for source, r in got.items():
        own = [n for i, n in enumerate(sizes) if ("a" if i % 2 else "b") == source]
        best = min(abs(sum(k * n for k, n in zip(copies, own)) - r["target"]) for copies in itertools.product(range(4), repeat=len(own)))
        assert abs(r["taken"] - r["target"]) <= best + r["least"]


def test_sources_of_long_documents_come_near_their_targets(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(n), "abc"[i % 3]) for i, n in enumerate(rng.integers(20_000, 180_000, 120))]
    df = spark.createDataFrame(sizes, "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) AS text", "source")
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in shares(df))
