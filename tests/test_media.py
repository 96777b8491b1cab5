import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attack as AT
from tidemark.operators import media as MD


def _lbp_plain(img):
    """One pixel and neighbour at a time, offsets rounded."""
    n = len(img)
    out = [0] * 10
    for r in range(n):
        for c in range(n):
            bits = []
            for p in range(8):
                y, x = r + round(-math.sin(2 * math.pi * p / 8), 5), c + round(math.cos(2 * math.pi * p / 8), 5)
                y0, x0 = math.floor(y), math.floor(x)
                g = lambda i, j: img[i][j] if 0 <= i < n and 0 <= j < n else 0.0
                row = lambda i: (1 - (x - x0)) * g(i, x0) + (x - x0) * g(i, x0 + 1)  # noqa: E731, B023
                v = (1 - (y - y0)) * row(y0) + (y - y0) * row(y0 + 1)
                bits.append(v - img[r][c] >= 0)
            turns = sum(a != b for a, b in zip(bits, bits[1:] + bits[:1]))
            out[sum(bits) if turns <= 2 else 9] += 1
    return out


def test_lbp_counts(spark):
    rng = np.random.default_rng(0)
    tiles = [np.full(64, 7.0), rng.integers(0, 256, 64).astype(float), np.zeros(64)]
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tiles)], "img_id long, pixels array<double>")
    got = {r.img_id: [int(x) for x in r.lbp] for r in MD.lbp_hist(df).collect()}
    # by hand: corners have three equal neighbours inside, edges five, the rest eight
    assert got[0] == [0, 0, 0, 4, 0, 24, 0, 0, 36, 0]
    assert all(got[i] == _lbp_plain(t.reshape(8, 8)) and sum(got[i]) == 64 for i, t in enumerate(tiles))


def _frames(x, length=2048, hop=512, mode="constant"):
    y = np.pad(x, length // 2, mode=mode)
    return [y[i * hop : i * hop + length] for i in range(1 + len(x) // hop)]


@pytest.mark.parametrize("n", [5, 64, 512, 3000, 9001])
def test_temporal_means_over_frames(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    got = MD.audio_temporal(spark.createDataFrame([("a", x.tolist())], "aud_id string, samples array<double>")).first()
    zcr = np.mean([np.mean(np.r_[False, np.diff(np.signbit(f))]) for f in _frames(x, mode="edge")])
    rms = np.mean([np.sqrt(np.mean(f**2)) for f in _frames(x)])
    assert got.zcr == pytest.approx(zcr) and got.rms == pytest.approx(rms)


def test_spectral_means_cover_the_whole_clip(spark):
    sr = 8000
    t = np.arange(12_000) / sr
    clip = np.where(t < 0.75, np.sin(2 * np.pi * 500 * t), np.sin(2 * np.pi * 2500 * t))
    df = spark.createDataFrame([(1, clip.tolist(), sr), (2, [0.0] * 100, sr), (3, clip[:64].tolist(), sr)], "aud_id long, samples array<double>, sr int")
    got = {r.aud_id: r for r in MD.audio_spectral(df).collect()}
    assert 1300 < got[1].centroid < 1700 and len(got[1].mfcc) == 20
    assert got[2].centroid == got[2].bandwidth == got[2].rolloff == 0
    frame = np.zeros(2048)
    frame[1024:1088] = clip[:64]
    mag = np.abs(np.fft.rfft(frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048))))
    freqs = np.fft.rfftfreq(2048, 1 / sr)
    assert got[3].centroid == pytest.approx((freqs * mag).sum() / mag.sum())


def test_mel_filters_have_equal_area():
    f = MD.mel_filters(22050, 2048, 128)
    area = f.sum(axis=1) * 22050 / 2048
    assert f.shape == (128, 1025) and (f >= 0).all() and np.allclose(area[20:], 1.0, atol=0.35) and abs(area.mean() - 1) < 0.05


def test_whitened_components_with_a_constant_column(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) * [1, 10, 0.1]
    x = np.c_[x, np.full(200, 5.0)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    got = np.array([r.reduced for r in MD.reduce_dims(df, 3).orderBy("id").collect()])
    assert np.allclose(got.var(axis=0, ddof=1), 1.0, atol=1e-6) and np.allclose(got.mean(axis=0), 0, atol=1e-9)


def test_attributions_of_the_rows_own_class(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, -1.0], 0)], "vec_id long, features array<double>, label int")
    got = {r.vec_id: r for r in AT.integrated_gradients_linear(df, [0.5, 2.0], label="label").collect()}
    assert got[1].attr_sum == pytest.approx(4.5) and got[2].attr_sum == pytest.approx(0.5)
    smooth = {r.vec_id: r.attr for r in AT.smoothgrad_linear(df, [0.5, 2.0], "vec_id").collect()}
    assert smooth[1] == pytest.approx([0.5, 4.0], abs=0.05) and smooth[2] == pytest.approx([1.5, -2.0], abs=0.05)
    q = {(r.label, r.q): r.value for r in AT.attr_quantiles(spark.createDataFrame([(0, float(i)) for i in range(5)], "label int, v double"), "v").collect()}
    assert q[(0, 0.5)] == 2.0 and q[(0, 0.05)] == pytest.approx(0.2)


def _brute_frames(vid, total, seed=42):
    md5 = lambda *p: hashlib.md5("|".join(str(x) for x in p if x is not None).encode()).hexdigest()
    u = lambda tag: int(md5(seed, vid, tag)[:8], 16) / 4294967296.0
    n_drop = 0 if total < 2 else max(0, min(total - 1, int(total * (0.05 + 0.10 * u("drop")))))
    kept = set(sorted(range(total), key=lambda f: md5(seed, vid, "d", f))[n_drop:])
    n = min(max(1, int(len(kept) * (0.3 + 0.2 * u("transform")))), len(kept))
    marked = set(sorted(kept, key=lambda f: md5(seed, vid, "t", f))[:n]) if total >= 2 else set()
    return {(vid, f, f in kept, f in marked) for f in range(total)}


def test_frames_are_chosen_within_the_row(spark):
    sizes = {1: 1, 2: 2, 3: 5, 4: 117, None: 31}
    videos = spark.createDataFrame([*sizes.items(), (9, None)], "video_id long, total_frames long")
    got = [tuple(r) for r in MD.perturb_frames(videos).collect()]
    assert len(got) == len(set(got)) and set(got) == set().union(*(_brute_frames(v, n) for v, n in sizes.items()))
    # no frame is shuffled or sorted outside its row
    plan = MD._frames_in_row(videos.withColumn("n_drop", F.lit(0)).withColumn("tr_ratio", F.lit(0.4)), 42, "video_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Exchange" not in text


def test_frames_of_repeated_ids_are_ranked_together(spark):
    twice = spark.createDataFrame([(7, 40), (7, 40)], "video_id long, total_frames long")
    got = MD.perturb_frames(twice).collect()
    n_drop = int(40 * (0.05 + 0.10 * int(hashlib.md5(b"42|7|drop").hexdigest()[:8], 16) / 4294967296.0))
    assert len(got) == 80 and sum(not r["kept"] for r in got) == n_drop
