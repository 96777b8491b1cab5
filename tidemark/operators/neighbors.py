"""Perturbed neighbours of each sample text.

Random choices are replaced by a replayable hash order
``md5('seed|sample|kind|k|pos')``. A sample is at most the 3000-character
tail of a text, so its tokens are one array and deletion, duplication and
swap are array expressions of the row: the content positions are sorted by
hash, the first ``m`` are the chosen ones, no shuffle. The substitution
kind takes any fill function; the default is a corpus context model (most
frequent middle token for a (left, right) pair, backing off to the most
frequent follower of the left token, then the most frequent token), built
with aggregations. Only the masked positions leave the row; the model is
joined to their distinct contexts, and the fills come back per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.text import ASCII_PUNCT_CLASS, tokens
from tidemark.session import spread

# Neighbour generation parameters of the reference.
MAX_TEXT_LEN = 3000
N_NEIGHBORS = 25  # n // 4 = 6 of each kind
MASK_SIZE = 0.1
MIN_MASKS = 5
MAX_MASKS = 40
KINDS = ("substitution", "deletion", "duplication", "swap")
SEED = 42


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tail_text(text: Column | str, max_len: int = MAX_TEXT_LEN) -> Column:
    """The last ``max_len`` characters."""
    return F.right(_c(text), F.lit(max_len))


def mask_count(n_tok: Column, n_content: Column) -> Column:
    """``min(max(int(0.1·n_tok), max(0, min(5, n_content − 1))), 40)``."""
    floor_part = F.floor(n_tok * MASK_SIZE).cast("int")
    min_masks = F.greatest(F.lit(0), F.least(F.lit(MIN_MASKS), n_content - 1))
    return F.least(F.greatest(floor_part, min_masks), F.lit(MAX_MASKS))


def prepare(samples: DataFrame, text: str = "input", id_col: str = "sample_id",
            max_len: int = MAX_TEXT_LEN) -> DataFrame:
    """N01–N04 per sample: ``(id, text, tokens, n_tok, n_content, m)``, dealt to all cores by id, as a small row becomes many."""
    s = spread(samples.select(id_col, tail_text(text, max_len).alias("text")), id_col)
    s = s.withColumn("tokens", tokens("text"))
    content = F.filter(F.col("tokens"), lambda t: ~t.rlike(ASCII_PUNCT_CLASS))
    s = s.withColumn("n_tok", F.size("tokens")).withColumn("n_content", F.size(content))
    return s.withColumn("m", mask_count(F.col("n_tok"), F.col("n_content")))


def token_rows(prep: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """N02/N03 long form ``(id, pos, tok, is_content)`` (positions 0-based)."""
    rows = prep.select(id_col, "m", "n_content", F.posexplode("tokens").alias("pos", "tok"))
    return rows.withColumn("is_content", ~F.col("tok").rlike(ASCII_PUNCT_CLASS))


def _hash(seed: int, id_col: str, kind: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(kind),
                             *[p.cast("string") for p in parts]))


def _content() -> Column:
    """The content positions (0-based)."""
    return F.filter(F.transform("tokens", lambda t, i: F.when(~t.rlike(ASCII_PUNCT_CLASS), i)), lambda i: i.isNotNull())


def _chosen(kind: str, places: Column, j: Column, seed: int, id_col: str) -> Column:
    """The first ``m`` of the content positions in the hash order of ``(id, kind, j)``."""
    order = F.sort_array(F.transform(places, lambda i: F.struct(_hash(seed, id_col, kind, j, i).alias("h"), i.alias("i"))))
    return F.transform(F.slice(order, 1, F.greatest(F.col("m"), F.lit(0))), lambda x: x["i"])


def _each(n_each: int, one) -> Column:
    """``[one(0), …, one(n_each − 1)]``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_each - 1)), one)


def _join_toks(arr: Column) -> Column:
    return F.array_join(arr, " ")


def _deletions(n_each: int, seed: int, id_col: str) -> Column:
    return let(_content(), lambda places: _each(n_each, lambda j: let(_chosen("deletion", places, j, seed, id_col), lambda ch: _join_toks(
        F.filter("tokens", lambda t, i: ~F.array_contains(ch, i))))))


def _duplications(n_each: int, seed: int, id_col: str) -> Column:
    twice = let(_content(), lambda places: _each(n_each, lambda j: let(_chosen("duplication", places, j, seed, id_col), lambda ch: _join_toks(
        F.transform("tokens", lambda t, i: F.when(F.array_contains(ch, i), F.concat(t, F.lit(" "), t)).otherwise(t))))))
    return F.when(F.col("m") <= F.col("n_content"), twice).otherwise(F.array().cast("array<string>"))


def _swap_pos(seed: int, id_col: str, j: Column, step: Column, side: str, n: Column) -> Column:
    h = _hash(seed, id_col, "swap", j, step, F.lit(side))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), n.cast("long")).cast("int")


def _swaps(n_each: int, seed: int, id_col: str) -> Column:
    n = F.col("n_tok")

    def one(j: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            places = F.struct(_swap_pos(seed, id_col, j, s, "a", n).alias("a"), _swap_pos(seed, id_col, j, s, "b", n).alias("b"))
            return let(places, lambda p: F.transform(acc, lambda x, i: F.when(i == p["a"], F.get(acc, p["b"]))
                                                     .when(i == p["b"], F.get(acc, p["a"])).otherwise(x)))

        return _join_toks(F.aggregate(F.sequence(F.lit(1), F.col("m")), F.col("tokens"), step))

    return F.when(F.col("m") > 0, _each(n_each, one)).otherwise(_each(n_each, lambda j: _join_toks(F.col("tokens"))))


def _rows(prep: DataFrame, kind: str, texts: Column, id_col: str) -> DataFrame:
    return prep.select(id_col, F.lit(kind).alias("kind"), F.posexplode(texts).alias("j", "neighbor"))


def deletion_neighbors(prep: DataFrame, n_each: int = N_NEIGHBORS // 4, seed: int = SEED,
                       id_col: str = "sample_id") -> DataFrame:
    """Drop ``m`` distinct content tokens (fewer when content runs out)."""
    return _rows(prep, "deletion", _deletions(n_each, seed, id_col), id_col)


def duplication_neighbors(prep: DataFrame, n_each: int = N_NEIGHBORS // 4, seed: int = SEED,
                          id_col: str = "sample_id") -> DataFrame:
    """Each of ``m`` distinct content tokens appears twice in a row; the kind is empty when
    ``m`` exceeds the number of content tokens."""
    return _rows(prep, "duplication", _duplications(n_each, seed, id_col), id_col)


def swap_neighbors(prep: DataFrame, n_each: int = N_NEIGHBORS // 4, seed: int = SEED,
                   id_col: str = "sample_id") -> DataFrame:
    """``m`` sequential swaps of two hash-chosen positions over all tokens (positions may repeat)."""
    return _rows(prep, "swap", _swaps(n_each, seed, id_col), id_col)


# --------------------------------------------------------------------------- N08
def context_model(prep: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill tables from the ``tokens`` of all samples: best middle per (left, right), best follower per left,
    and the most frequent token. Ties go to the smallest token."""
    seen = prep.select(F.explode(F.transform("tokens", lambda t, i: F.struct(
        t.alias("tok"), F.when(i > 0, F.get(F.col("tokens"), i - 1)).alias("left"), F.get(F.col("tokens"), i + 1).alias("right")))).alias("x"))
    t = seen.select("x.tok", "x.left", "x.right")

    def best(df: DataFrame, keys: list[str]) -> DataFrame:
        counts = df.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "tok")).alias("best")).select(
            *keys, F.col("best.tok").alias("fill"))

    tri = best(t.filter(F.col("left").isNotNull() & F.col("right").isNotNull()), ["left", "right"])
    bi = best(t.filter(F.col("left").isNotNull()), ["left"])
    uni = t.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("tok").asc()).limit(1)
    return tri, bi, uni.select(F.col("tok").alias("fill"))


def context_fills(contexts: DataFrame, model: tuple) -> DataFrame:
    """``(_l, _r, fill)`` of distinct contexts ``(left, right)``: by both sides, else by the left one, else the commonest token."""
    tri, bi, uni = model
    fills = contexts.join(tri.withColumnRenamed("fill", "f3"), ["left", "right"], "left").join(
        bi.withColumnRenamed("fill", "f2"), ["left"], "left").crossJoin(F.broadcast(uni.withColumnRenamed("fill", "f1")))
    return fills.select(F.col("left").alias("_l"), F.col("right").alias("_r"), F.coalesce("f3", "f2", "f1").alias("fill"))


def _substitutions(prep: DataFrame, n_each: int, seed: int, id_col: str, model: tuple | None) -> DataFrame:
    """``(id, subs)``: the substitution neighbours of every sample that has masked positions, in order."""
    masks = prep.select(id_col, "tokens", F.posexplode(let(_content(), lambda places: _each(
        n_each, lambda j: _chosen("substitution", places, j, seed, id_col)))).alias("j", "places"))
    at = F.transform("places", lambda p: F.struct(
        p.alias("pos"), F.when(p > 0, F.get(F.col("tokens"), p - 1)).alias("left"), F.get(F.col("tokens"), p + 1).alias("right")))
    masked = masks.select(id_col, "j", F.explode(at).alias("x")).select(id_col, "j", "x.pos", "x.left", "x.right")
    fills = context_fills(masked.select("left", "right").distinct(), model or context_model(prep))
    filled = masked.join(fills, F.col("left").eqNullSafe(F.col("_l")) & F.col("right").eqNullSafe(F.col("_r")))
    # at most 40 masks for each of a sample's neighbours
    per = filled.groupBy(id_col).agg(F.collect_list(F.struct("j", "pos", "fill")).alias("masks"))

    def one(j: Column) -> Column:
        mine = F.map_from_entries(F.transform(F.filter("masks", lambda x: x["j"] == j), lambda x: F.struct(x["pos"], x["fill"])))
        return let(mine, lambda m: _join_toks(F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at(m, i), t))))

    return prep.select(id_col, "tokens").join(per, id_col).select(id_col, _each(n_each, one).alias("subs"))


def _with_substitutions(prep: DataFrame, n_each: int, seed: int, id_col: str, model: tuple | None) -> DataFrame:
    """``prep`` with ``subs``; unmasked samples keep their text, failed ones (no content to mask) have none."""
    plain = F.when((F.col("n_content") > 0) | (F.col("m") == 0), _each(n_each, lambda j: _join_toks(F.col("tokens")))).otherwise(
        F.array().cast("array<string>"))
    out = prep.join(_substitutions(prep, n_each, seed, id_col, model), id_col, "left")
    return out.withColumn("subs", F.coalesce("subs", plain))


def substitution_neighbors(prep: DataFrame, n_each: int = N_NEIGHBORS // 4, seed: int = SEED,
                           id_col: str = "sample_id", model: tuple | None = None) -> DataFrame:
    """N08 (re-aimed): ``m`` hash-chosen content tokens replaced by the context model's fill.

    Masks are filled in one pass from the original neighbours;
    :func:`tidemark.operators.masked_fill.substitution_rounds` fills them one at a time. A sample without content tokens yields no substitution
    neighbours, as a failed fill does in the reference.
    """
    return _rows(_with_substitutions(prep, n_each, seed, id_col, model), "substitution", F.col("subs"), id_col)


# --------------------------------------------------------------------------- N09
def _named(kind: str):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("neighbor"))


def neighbors(samples: DataFrame, text: str = "input", id_col: str = "sample_id", n: int = N_NEIGHBORS,
              seed: int = SEED, max_len: int = MAX_TEXT_LEN) -> DataFrame:
    """``n // 4`` neighbours of each kind in the order substitution, deletion, duplication, swap;
    long form ``(id, k, kind, neighbor)`` with ``k`` dense over the kinds that succeeded."""
    each = n // 4
    prep = _with_substitutions(prepare(samples, text, id_col, max_len), each, seed, id_col, None)
    kinds = ((F.col("subs"), KINDS[0]), (_deletions(each, seed, id_col), KINDS[1]), (_duplications(each, seed, id_col), KINDS[2]),
             (_swaps(each, seed, id_col), KINDS[3]))
    rows = [F.transform(texts, _named(kind)) for texts, kind in kinds]
    out = prep.select(id_col, F.posexplode(F.concat(*rows)).alias("k", "x"))
    return out.select(id_col, "k", "x.kind", "x.neighbor")


# --------------------------------------------------------------------------- N10
def modality_neighbor_paths(nbrs: DataFrame, samples: DataFrame, output_dir: str, path_col: str = "modality",
                            id_col: str = "sample_id") -> DataFrame:
    """One perturbed media path per text neighbour, ``{dir}/{stem}_row{row}_n{k}{ext}`` (``.bin`` when the
    file has no extension); the row index is the sample id. A missing media path is an error."""
    s = samples.select(id_col, F.col(path_col).alias("_path"))
    fname = F.regexp_extract(F.col("_path"), r"[^/]*$", 0)
    ext = F.regexp_extract(fname, r"^.+(\.[^.]*)$", 1)
    stem = F.when(ext == "", fname).otherwise(F.expr("substring(_fname, 1, length(_fname) - length(_ext))"))
    s = s.withColumn("_fname", fname).withColumn("_ext", ext).withColumn("_stem", stem)
    out = nbrs.select(id_col, "k").join(s, id_col)
    name = F.format_string("%s/%s_row%d_n%d%s", F.lit(output_dir), F.col("_stem"), F.col(id_col), F.col("k"),
                           F.when(F.col("_ext") == "", F.lit(".bin")).otherwise(F.col("_ext")))
    checked = F.when(F.col("_path").isNull(), F.raise_error(F.concat(
        F.lit("missing media path for sample "), F.col(id_col).cast("string")))).otherwise(name)
    return out.select(id_col, "k", checked.alias("modality_neighbor"))
