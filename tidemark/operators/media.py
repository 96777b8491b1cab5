"""Media operators over pixel, waveform and frame tables.

Media arrive as tables: an 8×8 grey tile or a short waveform is an
``array<double>`` per row, a video is ``(video_id, total_frames, fps)``.
Transforms are native expressions: the 2-D DCT is a join with a bounded
64×64 basis table and a ``groupBy``, histograms are ``groupBy`` counts,
frame choices are hash-ranked windows per video (bounded by its frames).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.session import spread

# Frame sampling constants, histogram bins and DCT size used by the reference.
FPS = 2.0
FRAME_FACTOR = 2
FPS_MIN_FRAMES = 4
FPS_MAX_FRAMES = 768
HIST_BINS = 32
DCT_N = 20
TILE = 8
FRAME_LENGTH = 2048  # analysis frame of the audio features
HOP_LENGTH = 512
ZERO_THRESHOLD = 1e-10


# --------------------------------------------------------------------------- P04
def n_sampled_frames(total: Column, video_fps: Column, fps: float = FPS) -> Column:
    """Frames to sample: ``total / video_fps · fps`` clamped to [4, min(768, total)], floored to a multiple of 2."""
    max_frames = F.floor(F.least(F.lit(FPS_MAX_FRAMES), total) / FRAME_FACTOR) * FRAME_FACTOR
    min_frames = F.lit(int(math.ceil(FPS_MIN_FRAMES / FRAME_FACTOR) * FRAME_FACTOR))
    n = total / video_fps * fps
    n = F.least(F.least(F.greatest(n, min_frames), max_frames), total)
    n = (F.floor(n / FRAME_FACTOR) * FRAME_FACTOR).cast("int")
    return F.when((n >= FRAME_FACTOR) & (n <= total), n).otherwise(
        F.raise_error(F.concat(F.lit("nframes out of range for total "), total.cast("string"))))


def sample_frames(videos: DataFrame, id_col: str = "video_id") -> DataFrame:
    """Evenly spaced frame indices ``round_half_even(i · (total−1)/(n−1))`` per video."""
    v = videos.withColumn("nframes", n_sampled_frames(F.col("total_frames"), F.col("fps")))
    step = (F.col("total_frames") - 1) / (F.col("nframes") - 1)
    return v.select(id_col, "nframes", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("nframes") - 1), lambda i: F.bround(i * step, 0).cast("int"))).alias("i", "frame_idx"))


# --------------------------------------------------------------------------- P03
def _u(seed: int, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def perturb_frames(videos: DataFrame, seed: int = 42, id_col: str = "video_id") -> DataFrame:
    """Drop 5–15 % of frames and mark 30–50 % of the kept ones for an image transform.

    ``(video_id, frame_idx, kept, transformed)``; videos with fewer than two frames are unchanged. The frames of an id
    are chosen within its row, by the hash that stands at the cut of the sorted ones; only ids with several rows, whose
    frames are ranked together, go through windows.
    """
    vid = F.col(id_col)
    # few bytes and much work a row, so adaptive execution must not merge the partitions
    by_id = spread(videos.select(id_col, "total_frames"), id_col).groupBy(id_col).agg(
        F.collect_list("total_frames").alias("_totals"))

    def planned(v: DataFrame) -> DataFrame:
        v = v.select(id_col, "total_frames",
                     (0.05 + 0.10 * _u(seed, vid, F.lit("drop"))).alias("drop_ratio"),
                     (0.3 + 0.2 * _u(seed, vid, F.lit("transform"))).alias("tr_ratio"))
        return v.withColumn("n_drop", F.when(F.col("total_frames") < 2, 0).otherwise(
            F.greatest(F.lit(0), F.least(F.col("total_frames") - 1,
                                         F.floor(F.col("total_frames") * F.col("drop_ratio")).cast("int")))))

    single = planned(by_id.filter(F.size("_totals") == 1).select(id_col, F.col("_totals")[0].alias("total_frames")))
    several = planned(by_id.filter(F.size("_totals") > 1).select(id_col, F.explode("_totals").alias("total_frames")))
    return _frames_in_row(single, seed, id_col).unionByName(_frames_by_window(several, seed, id_col))


def _key(seed: int, id_col: str, kind: str) -> Column:
    """``seed|id|kind|``, to which the frame is added."""
    return F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(kind), F.lit(""))


def _frame_hash(key: Column, frame: Column) -> Column:
    return F.md5(F.concat(key, frame.cast("string")))


def _n_transformed(n_kept: Column) -> Column:
    return F.least(F.greatest(F.lit(1), F.floor(n_kept * F.col("tr_ratio")).cast("int")), n_kept)


def _up_to(hashes: Column, n: Column) -> Column:
    """The ``n``-th smallest hash; the empty string, which comes before all of them, where ``n`` is 0."""
    return F.when(n > 0, F.get(F.sort_array(hashes), n - 1)).otherwise(F.lit(""))


def _frames_in_row(v: DataFrame, seed: int, id_col: str) -> DataFrame:
    """The choices for ids with one row each."""
    keys = F.struct(_key(seed, id_col, "d").alias("d"), _key(seed, id_col, "t").alias("t"))
    frames = let(keys, lambda key: F.transform(F.sequence(F.lit(0), F.col("total_frames") - 1), lambda f: F.struct(
        f.alias("frame_idx"), _frame_hash(key["d"], f).alias("d"), _frame_hash(key["t"], f).alias("t"))))

    def chosen(fr: Column) -> Column:
        def marked(cut: Column) -> Column:
            n = _n_transformed(F.size(fr) - F.col("n_drop"))
            kept = F.transform(F.filter(fr, lambda x: x["d"] > cut), lambda x: x["t"])
            return let(_up_to(kept, n), lambda last: F.transform(fr, lambda x: F.struct(
                x["frame_idx"].alias("frame_idx"), (x["d"] > cut).alias("kept"),
                ((x["d"] > cut) & (x["t"] <= last) & (F.col("total_frames") >= 2)).alias("transformed"))))

        return let(_up_to(fr["d"], F.col("n_drop")), marked)

    return v.select(id_col, F.inline(let(frames, chosen)))


def _frames_by_window(v: DataFrame, seed: int, id_col: str) -> DataFrame:
    """The choices for ids with several rows, all their frames in one order."""
    frames = v.select("*", F.explode(F.sequence(F.lit(0), F.col("total_frames") - 1)).alias("frame_idx"))
    w = Window.partitionBy(id_col).orderBy(_frame_hash(_key(seed, id_col, "d"), F.col("frame_idx")))
    frames = frames.withColumn("kept", F.row_number().over(w) > F.col("n_drop"))
    kept_n = F.sum(F.col("kept").cast("int")).over(Window.partitionBy(id_col))
    frames = frames.withColumn("n_kept", kept_n)
    w2 = Window.partitionBy(id_col, "kept").orderBy(_frame_hash(_key(seed, id_col, "t"), F.col("frame_idx")))
    frames = frames.withColumn("transformed", F.col("kept") & (F.row_number().over(w2) <= _n_transformed(F.col("n_kept")))
                               & (F.col("total_frames") >= 2))
    return frames.select(id_col, "frame_idx", "kept", "transformed")


# --------------------------------------------------------------------------- tiles
def to_tile(values: Column) -> Column:
    """Rescale a 64-value vector to 0…255 grey pixels (per-vector min–max, rounded half up)."""
    lo, hi = F.array_min(values), F.array_max(values)
    rng = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.transform(values, lambda x: F.floor((x - lo) / rng * 255.0 + 0.5).cast("double"))


def color_hist(tiles: DataFrame, id_col: str = "img_id", pixels: str = "pixels", bins: int = HIST_BINS) -> DataFrame:
    """H33 (grey): counts per bin of width 256/bins: ``(id, bin, n)`` for non-empty bins."""
    width = 256.0 / bins
    px = tiles.select(id_col, F.explode(pixels).alias("p"))
    return px.groupBy(id_col, F.floor(F.col("p") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dct_basis(spark: SparkSession, n: int = TILE) -> DataFrame:
    """Orthonormal 2-D DCT-II basis ``(uv, xy, w)`` for an n×n tile: a constant n⁴-row parameter table."""
    c = [[math.sqrt((1.0 if u == 0 else 2.0) / n) * math.cos(math.pi * (2 * x + 1) * u / (2 * n)) for x in range(n)]
         for u in range(n)]
    rows = [(u * n + v, x * n + y, c[u][x] * c[v][y]) for u in range(n) for v in range(n) for x in range(n)
            for y in range(n)]
    return spark.createDataFrame(rows, "uv int, xy int, w double")


def dct_features(tiles: DataFrame, id_col: str = "img_id", pixels: str = "pixels", n_keep: int = DCT_N,
                 n: int = TILE) -> DataFrame:
    """First and last ``n_keep`` coefficients of the flattened orthonormal 2-D DCT: ``(id, pos, coef)``."""
    px = tiles.select(id_col, F.posexplode(pixels).alias("xy", "p"))
    coefs = px.join(F.broadcast(dct_basis(tiles.sparkSession, n)), "xy").groupBy(id_col, "uv").agg(
        F.sum(F.col("p") * F.col("w")).alias("coef"))
    total = n * n
    keep = (F.col("uv") < n_keep) | (F.col("uv") >= total - n_keep)
    pos = F.when(F.col("uv") < n_keep, F.col("uv")).otherwise(F.col("uv") - (total - 2 * n_keep))
    return coefs.filter(keep).select(id_col, pos.alias("pos"), "coef")


# --------------------------------------------------------------------------- waveforms
def audio_temporal(waves: DataFrame, id_col: str = "aud_id", samples: str = "samples",
                   frame_length: int = FRAME_LENGTH, hop: int = HOP_LENGTH) -> DataFrame:
    """Zero-crossing rate and RMS, means over centred frames of the whole waveform.

    Frame ``f`` covers the samples ``f·hop ± frame_length / 2``; what lies outside repeats the edge (no crossing) and is
    silent (no energy). A waveform shorter than one hop has one frame.
    """
    half = frame_length // 2
    x = F.col(samples)
    signs = F.transform(x, lambda v: F.when(v < -ZERO_THRESHOLD, F.lit(1)).otherwise(F.lit(0)))
    changes = let(signs, lambda g: F.transform(g, lambda v, i: F.when((i > 0) & (v != F.get(g, i - 1)), 1.0).otherwise(0.0)))
    power = F.transform(x, lambda v: v * v)

    def frames(values: Column, first: int, last: int, one) -> Column:
        def each(v: Column, f: Column) -> Column:
            lo = F.greatest(f * hop + first, F.lit(0))
            hi = F.least(f * hop + last, F.size(v) - 1)
            part = F.slice(v, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
            return one(F.aggregate(part, F.lit(0.0), lambda a, y: a + y) / float(frame_length))

        count = F.floor(F.size(x) / F.lit(hop)).cast("int")
        per = let(values, lambda v: F.transform(F.sequence(F.lit(0), count), lambda f: each(v, f)))
        return F.aggregate(per, F.lit(0.0), lambda a, y: a + y) / (count + 1)

    return waves.select(id_col, frames(changes, 1 - half, half - 1, lambda m: m).alias("zcr"),
                        frames(power, -half, half - 1, F.sqrt).alias("rms"))


# --------------------------------------------------------------------------- H37
def whitener(train: DataFrame, n: int, features: str = "features"):
    """Fit standardisation (population std) and ``n`` whitened principal components on ``train``.

    Returns a function that adds the projection of any frame as ``out``. ``n`` is capped by ``min(rows, columns)``.
    """
    dim = len(train.select(features).first()[0])
    rows = train.count()
    n = max(1, min(n, dim, rows))
    x = train.withColumn("_v", array_to_vector(F.col(features)))
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(x)
    # Spark's scaler divides by the sample std; rescale to the population std
    widen = math.sqrt(rows / max(rows - 1, 1))

    def scaled(df: DataFrame) -> DataFrame:
        out = scaler.transform(df.withColumn("_v", array_to_vector(F.col(features))))
        return out.withColumn("_s", array_to_vector(F.transform(vector_to_array("_s"), lambda v: v * widen)))

    pca = PCA(k=n, inputCol="_s", outputCol="_p").fit(scaled(train))
    # a constant column has no variance; every other one has rows / (rows - 1) after scaling
    total = widen * widen * sum(1 for v in scaler.std.toArray() if v > 0)
    scale = F.array(*[F.lit(1.0 / math.sqrt(max(float(v) * total, 1e-12))) for v in pca.explainedVariance.toArray()])

    def project(df: DataFrame, out: str = "reduced") -> DataFrame:
        proj = pca.transform(scaled(df)).withColumn(out, F.zip_with(vector_to_array("_p"), scale, lambda a, b: a * b))
        return proj.drop("_v", "_s", "_p")

    return project


def reduce_dims(df: DataFrame, n: int, features: str = "features", out: str = "reduced") -> DataFrame:
    """Standardise (population std) and project on ``n`` whitened principal components.

    ``n`` is capped by ``min(rows, columns)``.
    """
    return whitener(df, n, features)(df, out)


# --------------------------------------------------------------------------- P02
SEG_MIN_S, SEG_MAX_S = 0.05, 0.25
QUIET_GAIN = 0.7


def _uh(key: Column, *parts: str | Column) -> Column:
    """Uniform [0, 1) from ``md5(key|parts…)``."""
    h = F.md5(F.concat_ws("|", key, *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def perturb_audio(waves: DataFrame, n_neighbors: int = 6, seed: int = 42, id_col: str = "aud_id",
                  samples: str = "samples", sr: str = "sr") -> DataFrame:
    """Per neighbour k, 1–3 silent segments of 0.05–0.25 s (at most a quarter of the clip) and a 0.7
    gain when the neighbour's seed ≡ 1 (mod 4): ``(id, k, samples)``."""
    k = F.col("k")
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), k.cast("string"))
    rows = waves.select(id_col, samples, sr, F.explode(F.sequence(F.lit(0), F.lit(n_neighbors - 1))).alias("k"))
    n = F.size(F.col(samples))
    dur = n / F.col(sr)
    smax = F.least(F.lit(SEG_MAX_S), dur / 4)
    smax = F.when(smax <= SEG_MIN_S, F.lit(SEG_MIN_S + 0.01)).otherwise(smax)
    nseg = (F.floor(_uh(key, "nseg") * 3) + 1).cast("int")
    segs = F.transform(F.sequence(F.lit(1), nseg), lambda j: F.struct(
        F.least(F.floor(F.col(sr) * (SEG_MIN_S + (smax - SEG_MIN_S) * _uh(key, "len", j.cast("string")))).cast("int"),
                n - 1).alias("len"),
        j.alias("j")))
    segs = F.transform(segs, lambda s: F.struct(s["len"].alias("len"), F.floor(
        _uh(key, "start", s["j"].cast("string")) * F.greatest(F.lit(1), n - s["len"])).cast("int").alias("start")))
    seed_int = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    gain = F.when(F.pmod(seed_int, F.lit(4)) == 1, F.lit(QUIET_GAIN)).otherwise(F.lit(1.0))
    out = F.transform(F.col(samples), lambda x, i: F.when(F.exists(
        F.col("_segs"), lambda s: (s["len"] > 0) & (i >= s["start"]) & (i < s["start"] + s["len"])), F.lit(0.0))
        .otherwise(x) * F.col("_gain"))
    return rows.withColumn("_segs", segs).withColumn("_gain", gain).select(id_col, "k", out.alias(samples))


# --------------------------------------------------------------------------- H36, E04
def image_features(tiles: DataFrame, id_col: str = "img_id", pixels: str = "pixels") -> DataFrame:
    """Per image the concatenated feature vector ``DCT (first/last 20) ++ 32-bin histogram``."""
    dct = dct_features(tiles, id_col, pixels).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("pos", "coef"))).alias("_d"))
    hist = color_hist(tiles, id_col, pixels).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_h"))
    vec = F.concat(F.transform("_d", lambda x: x["coef"]),
                   F.transform(F.sequence(F.lit(0), F.lit(HIST_BINS - 1)),
                               lambda b: F.coalesce(F.element_at("_h", b), F.lit(0)).cast("double")))
    return tiles.select(id_col).join(dct, id_col, "left").join(hist, id_col, "left").select(
        id_col, F.when(F.col("_d").isNull(), F.array().cast("array<double>")).otherwise(vec).alias("features"))


def embed_modality(df: DataFrame, key: str, id_col: str, value: str) -> DataFrame:
    """E04 default embedder: image tiles → image features, waveforms → (zcr, rms); a null input gives an empty
    vector; any other key is an error."""
    if key == "image":
        return image_features(df.select(F.col(id_col).alias("img_id"), F.col(value).alias("pixels"))) \
            .withColumnRenamed("img_id", id_col).withColumnRenamed("features", "embeds")
    if key == "audio":
        t = audio_temporal(df.select(F.col(id_col).alias("aud_id"), F.col(value).alias("samples")))
        return t.select(F.col("aud_id").alias(id_col), F.when(F.col("zcr").isNull(), F.array().cast("array<double>"))
                        .otherwise(F.array("zcr", "rms")).alias("embeds"))
    raise ValueError(f"unknown modality key {key!r}")


# --------------------------------------------------------------------------- H40
def mel_filters(sr: float, n_fft: int, n_mels: int):
    """Triangular filters, evenly spaced on a scale that is linear up to 1 kHz and logarithmic above, of equal area."""
    import numpy as np

    step, knee, ratio = 200.0 / 3, 1000.0, np.log(6.4) / 27.0  # fixed values of the scale
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, 1e-9) / knee) / ratio)
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp(ratio * (m - knee / step)))
    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(sr / 2.0)), n_mels + 2))
    freqs = np.fft.rfftfreq(n_fft, 1.0 / sr)
    width = np.diff(edges)[:, None]
    ramps = edges[:, None] - freqs[None, :]
    filters = np.maximum(0.0, np.minimum(-ramps[:-2] / width[:-1], ramps[2:] / width[1:]))
    return filters * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def spectral_features(x, sr: float, n_fft: int = FRAME_LENGTH, hop: int = HOP_LENGTH, rolloff: float = 0.85, n_mfcc: int = 20, n_mels: int = 128):
    """``(centroid, bandwidth, roll-off, cepstral coefficients)``, means over all centred frames of one waveform."""
    import numpy as np

    x = np.pad(np.asarray(x, dtype=float), n_fft // 2)
    window = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / n_fft)  # periodic Hann
    count = 1 + (len(x) - n_fft) // hop
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[:: hop][:count]
    freqs, filters = np.fft.rfftfreq(n_fft, 1.0 / sr), mel_filters(sr, n_fft, n_mels)
    k = np.arange(n_mels)
    basis = np.cos(np.pi * np.arange(n_mfcc)[:, None] * (2 * k + 1) / (2 * n_mels)) * np.sqrt(2.0 / n_mels)
    basis[0] /= np.sqrt(2.0)
    sums, levels = np.zeros(3), []
    for s in range(0, count, 256):  # a bounded number of frames at a time
        mag = np.abs(np.fft.rfft(frames[s : s + 256] * window, axis=1))
        total = mag.sum(axis=1, keepdims=True)
        share = mag / np.where(total > 0, total, 1.0)
        centre = (share * freqs).sum(axis=1)
        sums[0] += centre.sum()
        sums[1] += np.sqrt((share * (freqs - centre[:, None]) ** 2).sum(axis=1)).sum()
        run = np.cumsum(mag, axis=1)
        sums[2] += freqs[(run >= rolloff * run[:, -1:]).argmax(axis=1)].sum()
        levels.append(10.0 * np.log10(np.maximum(1e-10, (mag**2) @ filters.T)))
    db = np.concatenate(levels)
    db = np.maximum(db, db.max() - 80.0)
    return (*(sums / count).tolist(), (db @ basis.T).mean(axis=0).tolist())


def audio_spectral(waves: DataFrame, id_col: str = "aud_id", samples: str = "samples", sr: str = "sr",
                   n_fft: int = FRAME_LENGTH, rolloff: float = 0.85, n_mfcc: int = 20) -> DataFrame:
    """Spectral centroid, bandwidth, 85 % roll-off and ``n_mfcc`` cepstral coefficients of whole waveforms.

    Means over centred frames of ``n_fft`` samples (zeros outside, periodic Hann window).
    """
    import pandas as pd

    kind = waves.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [spectral_features(x, float(rate), n_fft, rolloff=rolloff, n_mfcc=n_mfcc) for x, rate in zip(pdf[samples], pdf[sr])]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pd.DataFrame({id_col: pdf[id_col], "centroid": list(cols[0]), "bandwidth": list(cols[1]), "rolloff": list(cols[2]), "mfcc": list(cols[3])})

    schema = f"{id_col} {kind}, centroid double, bandwidth double, rolloff double, mfcc array<double>"
    return waves.select(id_col, samples, sr).mapInPandas(run, schema)


# --------------------------------------------------------------------------- H35
def patch_descriptors(tiles: DataFrame, id_col: str = "img_id", pixels: str = "pixels", n: int = TILE,
                      patch: int = 2) -> DataFrame:
    """Local descriptors: every non-overlapping ``patch``×``patch`` block of a tile, ``(id, patch_id, desc)``."""
    per_side = n // patch
    blocks = []
    for by in range(per_side):
        for bx in range(per_side):
            idx = [(by * patch + dy) * n + (bx * patch + dx) for dy in range(patch) for dx in range(patch)]
            blocks.append(F.struct(F.lit(by * per_side + bx).alias("patch_id"),
                                   F.array(*[F.col(pixels)[i] for i in idx]).alias("desc")))
    return tiles.select(id_col, F.inline(F.array(*blocks)))


def visual_words(descriptors: DataFrame, k: int, id_col: str = "img_id", seed: int = 42) -> DataFrame:
    """K-means codebook over all descriptors, then per image the count of descriptors nearest each word:
    ``(id, features array<double>)``; an image without descriptors gets zeros."""
    from pyspark.ml.clustering import KMeans

    d = descriptors.withColumn("_v", array_to_vector(F.col("desc")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="word").fit(d)
    words = model.transform(d).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    agg = words.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("_m"))
    ids = descriptors.select(id_col).distinct()
    vec = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0)).cast("double"))
    return ids.join(agg, id_col, "left").select(id_col, F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), k))
                                                .otherwise(vec).alias("features"))


# --------------------------------------------------------------------------- H34, P01 (numpy over Arrow batches)
def lbp_counts(tiles, n: int, points: int = 8, radius: float = 1.0):
    """Uniform local binary pattern counts of a stack of ``n``×``n`` tiles (bilinear neighbours, zero outside)."""
    import numpy as np

    img = np.asarray(tiles, dtype=float).reshape(-1, n, n)
    edge = int(np.ceil(radius)) + 1
    wide = np.pad(img, ((0, 0), (edge, edge), (edge, edge)))
    angle = 2 * np.pi * np.arange(points) / points
    # offsets are rounded, else sin(pi) is a hair below zero and equal neighbours compare as smaller
    rows, cols = np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5)
    bits = []
    place = np.arange(n)
    for r, c in zip(rows, cols):
        # fractions from the absolute places and columns before rows, so that rounding falls as in the usual formula
        y, x = place + r, place + c
        r0, c0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fr, fc = (y - r0)[None, :, None], (x - c0)[None, None, :]
        at = lambda i, j: wide[:, (r0 + edge + i)[:, None], (c0 + edge + j)[None, :]]  # noqa: E731, B023
        upper = (1 - fc) * at(0, 0) + fc * at(0, 1)
        lower = (1 - fc) * at(1, 0) + fc * at(1, 1)
        value = (1 - fr) * upper + fr * lower
        bits.append(value - img >= 0)
    bits = np.stack(bits)
    turns = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    codes = np.where(turns <= 2, bits.sum(axis=0), points + 1).reshape(len(img), -1)
    return (codes[:, :, None] == np.arange(points + 2)).sum(axis=1)


def lbp_hist(tiles: DataFrame, id_col: str = "img_id", pixels: str = "pixels", n: int = TILE,
             points: int = 8, radius: float = 1.0) -> DataFrame:
    """Uniform local binary pattern (P=8, R=1) → ``P + 2`` counts per tile."""
    import pandas as pd

    kind = tiles.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            counts = lbp_counts(pdf[pixels].tolist(), n, points, radius) if len(pdf) else []
            yield pd.DataFrame({id_col: pdf[id_col], "lbp": [c.astype(float).tolist() for c in counts]})

    return tiles.select(id_col, pixels).mapInPandas(run, f"{id_col} {kind}, lbp array<double>")


def perturb_images(tiles: DataFrame, n_neighbors: int = 6, seed: int = 42, id_col: str = "img_id",
                   pixels: str = "pixels", n: int = TILE) -> DataFrame:
    """Per neighbour k a seeded affine warp (rotation ±2.5°, translation ±2.5 px, shear) and brightness
    change, negative image when the neighbour's seed ≡ 2 (mod 5): ``(id, k, pixels)``."""
    import pandas as pd

    rows = tiles.select(id_col, pixels, F.explode(F.sequence(F.lit(0), F.lit(n_neighbors - 1))).alias("k"))
    rows = rows.withColumn("_seed", F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long"))

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for px, s in zip(pdf[pixels], pdf["_seed"]):
                rng = np.random.default_rng(int(s))
                img = np.asarray(px, dtype=float).reshape(n, n)
                ang = np.deg2rad(rng.uniform(-2.5, 2.5))
                tx, ty = rng.uniform(-2.5, 2.5, size=2)
                sh = np.deg2rad(rng.uniform(-1.75, 1.75))
                a = np.array([[np.cos(ang), -np.sin(ang + sh)], [np.sin(ang), np.cos(ang + sh)]])
                inv = np.linalg.inv(a)
                ctr = (n - 1) / 2.0
                res = np.zeros_like(img)
                for r in range(n):
                    for c in range(n):
                        y, x = inv @ np.array([r - ctr - ty, c - ctr - tx]) + ctr
                        yi, xi = int(round(y)), int(round(x))
                        if 0 <= yi < n and 0 <= xi < n:
                            res[r, c] = img[yi, xi]
                res = np.clip(res * (0.75 + rng.normal() * 0.5), 0, 255)
                if int(s) % 5 == 2:
                    res = 255.0 - res
                out.append(res.ravel().tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "k": pdf["k"], pixels: out})

    return rows.mapInPandas(run, f"{id_col} long, k int, {pixels} array<double>")
