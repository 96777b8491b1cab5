"""Queries for the neighbour, embedding, loss, delta and normalisation stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import masked_fill as MF
from tidemark.operators import neighbors as N
from tidemark.plans import views as V
from tidemark.plans.catalog import query

PUNCT_SQL = r"'[!-/:-@\[-`{-~]'"
SPACE_SPLIT_SQL = r"'[\s\x{0B}\p{Z}\x{1C}-\x{1F}\x{85}]+'"
SAMPLES_SQL = (
    "samples AS (SELECT u.conv_id * 1000 + u.turn AS sample_id, u.conv_id, u.text AS input, a.text AS answer, "
    "'ds' || CAST(u.conv_id % 3 AS VARCHAR) AS ds_name FROM conversations u JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
)
PREP_SQL = (
    f"prep0 AS (SELECT sample_id, text, list_filter(string_split_regex(text, {SPACE_SPLIT_SQL}), lambda t: t <> '') "
    "AS tokens FROM (SELECT sample_id, right(input, 3000) AS text FROM samples)), "
    f"prep1 AS (SELECT *, len(tokens) AS n_tok, len(list_filter(tokens, lambda t: NOT regexp_matches(t, {PUNCT_SQL}))) "
    "AS n_content FROM prep0), "
    "prep AS (SELECT *, least(greatest(CAST(floor(CAST(n_tok AS DOUBLE) * 0.1) AS INTEGER), "
    "greatest(0, least(5, n_content - 1))), 40) AS m FROM prep1), "
    "tok AS (SELECT sample_id, m, n_content, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS pos FROM prep), "
    f"tokc AS (SELECT *, NOT regexp_matches(tok, {PUNCT_SQL}) AS is_content FROM tok), "
    "base AS (SELECT sample_id, m, n_content, j FROM prep, range(0, 6) r(j))"
)


def _rank_sql(kind: str, src: str = "tokc") -> str:
    h = f"md5('42|' || CAST(sample_id AS VARCHAR) || '|{kind}|' || CAST(j AS VARCHAR) || '|' || CAST(pos AS VARCHAR))"
    return (
        f"(SELECT *, CASE WHEN is_content THEN row_number() OVER (PARTITION BY sample_id, j, is_content ORDER BY {h}) "
        f"END AS rank FROM {src}, range(0, 6) r(j))"
    )


def _kind_sql(kind: str) -> str:
    """CTE ``{kind}_n(sample_id, kind, j, neighbor)`` for deletion / duplication / substitution."""
    if kind == "deletion":
        agg = (f"SELECT sample_id, j, string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE NOT coalesce(rank <= m, false)) "
               f"AS neighbor FROM {_rank_sql(kind)} GROUP BY sample_id, j")
        filt = ""
    elif kind == "duplication":
        agg = (f"SELECT sample_id, j, string_agg(t2, ' ' ORDER BY pos) AS neighbor FROM (SELECT sample_id, j, pos, "
               f"unnest(CASE WHEN coalesce(rank <= m, false) THEN [tok, tok] ELSE [tok] END) AS t2 "
               f"FROM {_rank_sql(kind)}) GROUP BY sample_id, j")
        filt = " WHERE b.m <= b.n_content"
    else:
        agg = (f"SELECT r.sample_id, r.j, string_agg(CASE WHEN coalesce(r.rank <= r.m, false) THEN "
               f"coalesce(tri.fill, bi.fill, (SELECT fill FROM uni)) ELSE r.tok END, ' ' ORDER BY r.pos) AS neighbor "
               f"FROM {_rank_sql(kind, 'ctx')} r LEFT JOIN tri ON tri.lft = r.lft AND tri.rgt = r.rgt "
               f"LEFT JOIN bi ON bi.lft = r.lft GROUP BY r.sample_id, r.j")
        filt = " WHERE b.n_content > 0 OR b.m = 0"
    return (
        f"{kind}_a AS ({agg}), {kind}_n AS (SELECT b.sample_id, '{kind}' AS kind, b.j, coalesce(a.neighbor, '') "
        f"AS neighbor FROM base b LEFT JOIN {kind}_a a ON a.sample_id = b.sample_id AND a.j = b.j{filt})"
    )


CTX_SQL = (
    "ctx AS (SELECT *, lag(tok) OVER (PARTITION BY sample_id ORDER BY pos) AS lft, "
    "lead(tok) OVER (PARTITION BY sample_id ORDER BY pos) AS rgt FROM tokc), "
    "tri AS (SELECT lft, rgt, min(tok) AS fill FROM (SELECT lft, rgt, tok, count(*) AS n, max(count(*)) OVER "
    "(PARTITION BY lft, rgt) AS mx FROM ctx WHERE lft IS NOT NULL AND rgt IS NOT NULL GROUP BY lft, rgt, tok) "
    "WHERE n = mx GROUP BY lft, rgt), "
    "bi AS (SELECT lft, min(tok) AS fill FROM (SELECT lft, tok, count(*) AS n, max(count(*)) OVER (PARTITION BY lft) "
    "AS mx FROM ctx WHERE lft IS NOT NULL GROUP BY lft, tok) WHERE n = mx GROUP BY lft), "
    "uni AS (SELECT min(tok) AS fill FROM (SELECT tok, count(*) AS n, max(count(*)) OVER () AS mx FROM ctx "
    "GROUP BY tok) WHERE n = mx)"
)


def _swap_pos_sql(side: str) -> str:
    return (
        f"(CAST(('0x' || substr(md5('42|' || CAST(sample_id AS VARCHAR) || '|swap|' || CAST(j AS VARCHAR) || '|' || "
        f"CAST(s AS VARCHAR) || '|{side}'), 1, 8)) AS BIGINT) % n_tok)"
    )


SWAP_SQL = (
    "swap_n AS (SELECT sample_id, 'swap' AS kind, j, array_to_string(CASE WHEN m > 0 THEN list_reduce(range(1, m + 1), "
    f"lambda acc, s: list_transform(acc, lambda x, i: CASE WHEN i - 1 = {_swap_pos_sql('a')} THEN acc[{_swap_pos_sql('b')} + 1] "
    f"WHEN i - 1 = {_swap_pos_sql('b')} THEN acc[{_swap_pos_sql('a')} + 1] ELSE x END), tokens) ELSE tokens END, ' ') "
    "AS neighbor FROM prep, range(0, 6) r(j))"
)


def _prep(spark, sf_dir):
    return N.prepare(V.samples(spark, sf_dir))


@query("n01_tail_text", f"WITH {SAMPLES_SQL} SELECT sample_id, right(input, 3000) AS text FROM samples")
def n01(spark, sf_dir):
    return V.samples(spark, sf_dir).select("sample_id", N.tail_text("input").alias("text"))


@query(
    "n04_mask_count",
    f"WITH {SAMPLES_SQL}, {PREP_SQL} SELECT sample_id, CAST(n_tok AS BIGINT) AS n_tok, "
    "CAST(n_content AS BIGINT) AS n_content, CAST(m AS BIGINT) AS m FROM prep",
)
def n04(spark, sf_dir):
    """Token count, content-token count and mask count per sample."""
    return _prep(spark, sf_dir).select("sample_id", "n_tok", "n_content", "m")


@query(
    "n03_content_positions",
    f"WITH {SAMPLES_SQL}, {PREP_SQL} SELECT sample_id, CAST(pos AS BIGINT) AS pos, tok FROM tokc WHERE is_content",
)
def n03(spark, sf_dir):
    rows = N.token_rows(_prep(spark, sf_dir))
    return rows.filter("is_content").select("sample_id", "pos", "tok")


def _kind_query(kind: str) -> str:
    pre = f"{CTX_SQL}, " if kind == "substitution" else ""
    return (f"WITH {SAMPLES_SQL}, {PREP_SQL}, {pre}{_kind_sql(kind)} SELECT sample_id, CAST(j AS BIGINT) AS j, neighbor "
            f"FROM {kind}_n")


@query("n05_deletion_neighbors", _kind_query("deletion"))
def n05(spark, sf_dir):
    return N.deletion_neighbors(_prep(spark, sf_dir)).select("sample_id", "j", "neighbor")


@query("n06_duplication_neighbors", _kind_query("duplication"))
def n06(spark, sf_dir):
    return N.duplication_neighbors(_prep(spark, sf_dir)).select("sample_id", "j", "neighbor")


@query("n07_swap_neighbors", f"WITH {SAMPLES_SQL}, {PREP_SQL}, {SWAP_SQL} SELECT sample_id, CAST(j AS BIGINT) AS j, "
       "neighbor FROM swap_n")
def n07(spark, sf_dir):
    return N.swap_neighbors(_prep(spark, sf_dir)).select("sample_id", "j", "neighbor")


@query("n08_substitution_neighbors", _kind_query("substitution"))
def n08(spark, sf_dir):
    return N.substitution_neighbors(_prep(spark, sf_dir)).select("sample_id", "j", "neighbor")


# one recursion step per mask: the position first in the hash order of the round, filled from the present neighbours
_ROUNDS_SQL = (
    "RECURSIVE {ctes}, turn AS (SELECT sample_id, CAST(j AS INTEGER) AS j, m, 0 AS r, tokens AS toks FROM prep, range(0, 6) g(j) "
    "WHERE n_content > 0 OR m <= 0 UNION ALL SELECT q.sample_id, q.j, q.m, q.r, CASE WHEN q.pos IS NULL THEN q.toks ELSE "
    "q.toks[1:q.pos] || [coalesce(tri.fill, bi.fill, (SELECT fill FROM uni))] || q.toks[q.pos + 2:] END FROM ("
    "SELECT *, CASE WHEN pos > 0 THEN toks[pos] END AS lft, toks[pos + 2] AS rgt FROM (SELECT sample_id, j, m, r + 1 AS r, toks, "
    "CAST(string_split(list_min(list_transform(list_filter(range(0, len(toks)), lambda p: NOT regexp_matches(toks[p + 1], {punct})), "
    "lambda p: md5('42|' || CAST(sample_id AS VARCHAR) || '|substitution|' || CAST(j AS VARCHAR) || '|' || CAST(r + 1 AS VARCHAR) "
    "|| '|' || CAST(p AS VARCHAR)) || '|' || CAST(p AS VARCHAR))), '|')[2] AS BIGINT) AS pos FROM turn WHERE r < m)) q "
    "LEFT JOIN tri ON tri.lft = q.lft AND tri.rgt = q.rgt LEFT JOIN bi ON bi.lft = q.lft) "
    "SELECT sample_id, CAST(j AS BIGINT) AS j, array_to_string(toks, ' ') AS neighbor FROM turn WHERE r = greatest(m, 0)"
)


@query("n08b_substitution_rounds", "WITH " + _ROUNDS_SQL.replace("{ctes}", f"{SAMPLES_SQL}, {PREP_SQL}, {CTX_SQL}").replace("{punct}", PUNCT_SQL))
def n08b(spark, sf_dir):
    """Substitution neighbours with one mask filled at a time, each seeing the fills before it."""
    return MF.substitution_rounds(_prep(spark, sf_dir)).select("sample_id", "j", "neighbor")


NEIGHBORS_SQL = (
    f"{SAMPLES_SQL}, {PREP_SQL}, {CTX_SQL}, {_kind_sql('substitution')}, {_kind_sql('deletion')}, "
    f"{_kind_sql('duplication')}, {SWAP_SQL}, "
    "alln AS (SELECT * FROM substitution_n UNION ALL SELECT * FROM deletion_n UNION ALL SELECT * FROM duplication_n "
    "UNION ALL SELECT * FROM swap_n), "
    "nbrs AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY CASE kind WHEN 'substitution' "
    "THEN 0 WHEN 'deletion' THEN 1 WHEN 'duplication' THEN 2 ELSE 3 END, j) - 1 AS k, kind, neighbor FROM alln)"
)


@query("n09_neighbors", f"WITH {NEIGHBORS_SQL} SELECT sample_id, CAST(k AS BIGINT) AS k, kind, neighbor FROM nbrs")
def n09(spark, sf_dir):
    return N.neighbors(V.samples(spark, sf_dir))


# --------------------------------------------------------------------------- embeddings
from tidemark.functions.arrays import l2_norm  # noqa: E402
from tidemark.operators import deltas as DL  # noqa: E402
from tidemark.operators import embed as EM  # noqa: E402
from tidemark.operators import loss as LO  # noqa: E402
from tidemark.operators import normalize as NZ  # noqa: E402
from tidemark.session import cut_lineage, stored
from tidemark.sources.tables import table  # noqa: E402

class _Toks:
    """``format(t=…)`` builder for the whitespace tokeniser (the regex holds braces)."""

    def __init__(self, lower: bool = True):
        self.lower = lower

    def format(self, t: str) -> str:
        arg = f"lower({t})" if self.lower else t
        return f"list_filter(string_split_regex({arg}, {SPACE_SPLIT_SQL}), lambda x: x <> '')"

    def replace(self, *_a):
        return _Toks(lower=False)


TOKS_SQL = _Toks()


def _embed_sql(src: str, ids: str, name: str = "emb") -> str:
    """``{name}(ids…, dim, value)`` from ``src(ids…, text)``."""
    return (
        f"{name}_t AS (SELECT {ids}, unnest({TOKS_SQL.format(t='text')}) AS tok FROM {src}), "
        f"{name}_s AS (SELECT {ids}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS dim, "
        f"sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS raw "
        f"FROM {name}_t GROUP BY ALL), "
        f"{name} AS (SELECT {ids}, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {ids})) AS value FROM {name}_s)"
    )


@query(
    "e03_embed_text",
    f"WITH {SAMPLES_SQL}, tx AS (SELECT sample_id, input || ' ' || answer AS text FROM samples), "
    f"{_embed_sql('tx', 'sample_id')} SELECT sample_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM emb",
)
def e03(spark, sf_dir):
    s = V.samples(spark, sf_dir).select("sample_id", EM.compose_text(F.col("input"), F.col("answer"), None, False)
                                        .alias("text"))
    return EM.hashed_embedding(s, ["sample_id"], "text")


_E05_SQL = (
    f"{NEIGHBORS_SQL}, dn AS (SELECT sample_id, neighbor, min(k) AS k FROM nbrs GROUP BY sample_id, neighbor), "
    "etx AS (SELECT d.sample_id, d.k, d.neighbor || ' ' || s.answer AS text FROM dn d JOIN samples s USING (sample_id) "
    "UNION ALL SELECT sample_id, -1 AS k, input || ' ' || answer AS text FROM samples), "
    f"{_embed_sql('etx', 'sample_id, k')}"
)


@query("e01_explode_neighbors", f"WITH {NEIGHBORS_SQL}, dn AS (SELECT sample_id, neighbor, min(k) AS k FROM nbrs "
       "GROUP BY sample_id, neighbor) SELECT sample_id, CAST(k AS BIGINT) AS k, neighbor FROM dn")
def e01(spark, sf_dir):
    return EM.explode_neighbors(N.neighbors(V.samples(spark, sf_dir)))


@query("e05_embed_stage", f"WITH {_E05_SQL} SELECT sample_id, CAST(k AS BIGINT) AS k, CAST(dim AS BIGINT) AS dim, "
       "round(value, 6) AS value FROM emb")
def e05(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return EM.embed_stage(s, N.neighbors(s))


# --------------------------------------------------------------------------- loss
def _lm_sql(name: str, where: str) -> str:
    return (
        f"{name}_c AS (SELECT {TOKS_SQL.format(t='text')} AS t FROM documents WHERE {where}), "
        f"{name}_uni AS (SELECT tok, count(*) AS c FROM (SELECT unnest(t) AS tok FROM {name}_c) GROUP BY tok), "
        f"{name}_bi AS (SELECT prev, tok, count(*) AS c FROM (SELECT unnest(list_slice(t, 1, len(t) - 1)) AS prev, "
        f"unnest(list_slice(t, 2, len(t))) AS tok FROM {name}_c) GROUP BY ALL), "
        f"{name}_tot AS (SELECT sum(c) AS n_tokens, count(*) AS vocab FROM {name}_uni)"
    )


def _score_sql(name: str, lm: str, src: str, ids: str) -> str:
    """``{name}(ids…, loss)`` for ``src(ids…, text)`` under bigram model ``lm``."""
    return (
        f"{name}_r AS (SELECT {ids}, unnest(t) AS tok, unnest(list_prepend(NULL, list_slice(t, 1, len(t) - 1))) AS prev "
        f"FROM (SELECT {ids}, {TOKS_SQL.format(t='text')} AS t FROM {src})), "
        f"{name} AS (SELECT {', '.join('r.' + i.strip() for i in ids.split(','))}, avg(-ln(CASE WHEN r.prev IS NULL THEN "
        f"(coalesce(u2.c, 0) + 1.0) / (tot.n_tokens + 1.0 * tot.vocab) ELSE (coalesce(b.c, 0) + 1.0) / "
        f"(coalesce(u1.c, 0) + 1.0 * tot.vocab) END)) AS loss FROM {name}_r r LEFT JOIN {lm}_bi b ON b.prev = r.prev "
        f"AND b.tok = r.tok LEFT JOIN {lm}_uni u1 ON u1.tok = r.prev LEFT JOIN {lm}_uni u2 ON u2.tok = r.tok, "
        f"{lm}_tot tot WHERE r.tok IS NOT NULL GROUP BY ALL)"
    )


def _lm(spark, sf_dir, parity: int):
    docs = table(spark, sf_dir, "documents").filter(F.pmod(F.col("doc_id"), F.lit(2)) == parity)
    return LO.train_bigram_lm(docs)


@query(
    "l02_score_loss",
    f"WITH {SAMPLES_SQL}, {_lm_sql('lma', 'doc_id % 2 = 0')}, tx AS (SELECT sample_id, input || ' ' || answer AS text "
    f"FROM samples), {_score_sql('sc', 'lma', 'tx', 'sample_id')} SELECT sample_id, round(loss, 6) AS loss FROM sc",
)
def l02(spark, sf_dir):
    s = V.samples(spark, sf_dir).select("sample_id", F.concat_ws(" ", "input", "answer").alias("text"))
    return LO.score_loss(s, ["sample_id"], "text", _lm(spark, sf_dir, 0))


_L06_CTES = (
    f"{NEIGHBORS_SQL}, {_lm_sql('lma', 'doc_id % 2 = 0')}, {_lm_sql('lmb', 'doc_id % 2 = 1')}, "
    "ptx AS (SELECT n.sample_id, n.k, n.neighbor || ' ' || s.answer AS text FROM nbrs n JOIN samples s USING (sample_id) "
    "UNION ALL SELECT sample_id, -1 AS k, input || ' ' || answer AS text FROM samples), "
    f"{_score_sql('sca', 'lma', 'ptx', 'sample_id, k')}, {_score_sql('scb', 'lmb', 'ptx', 'sample_id, k')}, "
    "losses AS (SELECT n.sample_id, n.k, 'ngram-a' AS model_name, 1 AS label, n.loss AS neighbor_loss, "
    "o.loss AS input_loss FROM sca n LEFT JOIN sca o ON o.sample_id = n.sample_id AND o.k = -1 WHERE n.k >= 0 "
    "UNION ALL SELECT n.sample_id, n.k, 'ngram-b', 0, n.loss, o.loss FROM scb n LEFT JOIN scb o "
    "ON o.sample_id = n.sample_id AND o.k = -1 WHERE n.k >= 0)"
)


def _losses(spark, sf_dir, samples=None, nbrs=None):
    s = samples if samples is not None else V.samples(spark, sf_dir)
    nb = nbrs if nbrs is not None else N.neighbors(s)
    return LO.loss_stages(s, nb, {"ngram-a": (_lm(spark, sf_dir, 0), 1), "ngram-b": (_lm(spark, sf_dir, 1), 0)})


@query("l06_loss_stage", f"WITH {_L06_CTES} SELECT sample_id, CAST(k AS BIGINT) AS k, model_name, "
       "CAST(label AS BIGINT) AS label, round(neighbor_loss, 6) AS neighbor_loss, round(input_loss, 6) AS input_loss "
       "FROM losses")
def l06(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return _losses(spark, sf_dir, s, cut_lineage(N.neighbors(s)))


@query(
    "l01_loss_pairs",
    f"WITH {NEIGHBORS_SQL} SELECT n.sample_id, CAST(n.k AS BIGINT) AS k, n.neighbor || ' ' || s.answer AS text "
    "FROM nbrs n JOIN samples s USING (sample_id) UNION ALL SELECT sample_id, -1, input || ' ' || answer FROM samples",
)
def l01(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return LO.loss_pairs(s, N.neighbors(s))


_CHAT_SQL = (
    "chat AS (SELECT sample_id, regexp_replace('<|user|> ' || input || ' <|assistant|> ' || answer, "
    "'<(audio|video|image)>', ' ', 'g') AS chat FROM samples)"
)


@query("l05_render_chat", f"WITH {SAMPLES_SQL}, {_CHAT_SQL} SELECT sample_id, chat FROM chat")
def l05(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return s.select("sample_id", LO.render_chat(None, F.col("input"), F.col("answer")).alias("chat"))


@query(
    "l03_mask_prefix",
    f"WITH {SAMPLES_SQL}, {_CHAT_SQL}, ct AS (SELECT sample_id, {TOKS_SQL.replace('lower({t})', '{t}').format(t='chat')} "
    "AS t FROM chat), lm AS (SELECT sample_id, t, coalesce(list_max(list_transform(range(1, len(t) + 1), "
    "lambda i: CASE WHEN t[i] = '<|assistant|>' THEN i ELSE 0 END)), 0) AS last FROM ct) "
    "SELECT sample_id, CAST(CASE WHEN last = 0 THEN len(t) ELSE len(t) - last END AS BIGINT) AS n_counted FROM lm",
)
def l03(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    from tidemark.functions.text import tokens as _tokens

    chat = LO.render_chat(None, F.col("input"), F.col("answer"))
    return s.select("sample_id", F.size(LO.mask_prefix(_tokens(chat))).alias("n_counted"))


@query(
    "l04_truncate_tokens",
    f"WITH {SAMPLES_SQL}, {_CHAT_SQL}, ct AS (SELECT sample_id, {TOKS_SQL.replace('lower({t})', '{t}').format(t='chat')} "
    "AS t FROM chat) SELECT sample_id, CAST(least(len(t), 2048) AS BIGINT) AS n_first, "
    "CAST(least(len(t), 4096) AS BIGINT) AS n_last, t[len(t)] AS last_token FROM ct",
)
def l04(spark, sf_dir):
    from tidemark.functions.text import tokens as _tokens

    t = _tokens(LO.render_chat(None, F.col("input"), F.col("answer")))
    s = V.samples(spark, sf_dir).select("sample_id", t.alias("t"))
    last = LO.truncate_tokens(F.col("t"), LO.LAST_TOKENS, "last")
    return s.select("sample_id", F.size(LO.truncate_tokens(F.col("t"), LO.FIRST_TOKENS)).alias("n_first"),
                    F.size(last).alias("n_last"), F.element_at(last, -1).alias("last_token"))


# --------------------------------------------------------------------------- deltas
EVENTS_SQL = (
    "el AS (SELECT e.user_id AS sample_id, e.event_id AS k, e.event_type AS ds_name, CASE e.user_id % 3 WHEN 0 THEN "
    "'no_leak' WHEN 1 THEN 'leak' ELSE 'other' END AS model_name, CAST(e.user_id % 2 = 0 AS INTEGER) AS label, "
    "e.value AS neighbor_loss, f.input_loss, e.value - f.input_loss AS loss_delta FROM events e JOIN "
    "(SELECT user_id, first(value ORDER BY ts, event_id) AS input_loss FROM events GROUP BY user_id) f "
    "ON f.user_id = e.user_id)"
)
_STATS_SQL = ("st AS (SELECT ds_name, model_name, avg(loss_delta) AS mean, var_pop(loss_delta) AS std, "
              "min(loss_delta) AS min_loss, max(loss_delta) - min(loss_delta) AS loss_diff FROM el "
              "WHERE model_name <> 'other' GROUP BY ds_name, model_name)")
_LOOKUP_SQL = (
    "lk AS (SELECT el.*, coalesce(x.mean, f.mean) AS mean, coalesce(x.std, f.std) AS std, "
    "coalesce(x.min_loss, f.min_loss) AS min_loss, coalesce(x.loss_diff, f.loss_diff) AS loss_diff FROM el "
    "LEFT JOIN st x ON x.ds_name = el.ds_name AND x.model_name = el.model_name "
    "LEFT JOIN st f ON f.ds_name = el.ds_name AND f.model_name = 'no_leak')"
)


def _ev(spark, sf_dir):
    return V.event_losses(spark, sf_dir)


def _ev_stats(ev):
    kept = ev.filter(F.col("model_name") != "other")
    return NZ.loss_mean_var(kept).join(NZ.loss_min_range(kept), NZ.GROUP)


@query("d03_carry_forward", f"WITH {EVENTS_SQL} SELECT sample_id, k, round(input_loss, 6) AS input_loss FROM el")
def d03(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.groupBy(F.col("user_id").alias("sample_id")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("input_loss"))
    rows = e.select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("k"))
    return DL.carry_forward(rows, first, ["input_loss"])


@query("d04_loss_delta", f"WITH {EVENTS_SQL} SELECT sample_id, k, round(neighbor_loss - input_loss, 6) AS loss_delta, "
       "round(input_loss - neighbor_loss, 6) AS loss_delta_old FROM el")
def d04(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return ev.select("sample_id", "k", DL.loss_delta().alias("loss_delta"),
                     DL.loss_delta(sign="input_minus_neighbor").alias("loss_delta_old"))


@query("d06_attach_stats", f"WITH {EVENTS_SQL}, {_STATS_SQL} SELECT el.sample_id, el.k, round(coalesce(st.mean, 0.0), 6) "
       "AS mean, round(coalesce(st.std, 1.0), 6) AS std FROM el LEFT JOIN st ON st.ds_name = el.ds_name AND "
       "st.model_name = el.model_name")
def d06(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    kept = ev.filter(F.col("model_name") != "other")
    return DL.attach_stats(ev, NZ.loss_mean_var(kept)).select("sample_id", "k", "mean", "std")


@query("z01_loss_mean_var", f"WITH {EVENTS_SQL} SELECT ds_name, model_name, round(avg(loss_delta), 6) AS mean, "
       "round(var_pop(loss_delta), 6) AS std FROM el GROUP BY ds_name, model_name")
def z01(spark, sf_dir):
    return NZ.loss_mean_var(_ev(spark, sf_dir))


@query("z02_loss_min_range", f"WITH {EVENTS_SQL} SELECT ds_name, model_name, round(min(loss_delta), 6) AS min_loss, "
       "round(max(loss_delta) - min(loss_delta), 6) AS loss_diff FROM el GROUP BY ds_name, model_name")
def z02(spark, sf_dir):
    return NZ.loss_min_range(_ev(spark, sf_dir))


@query("z03_lookup_stats", f"WITH {EVENTS_SQL}, {_STATS_SQL}, {_LOOKUP_SQL} SELECT sample_id, k, round(mean, 6) AS mean, "
       "round(std, 6) AS std FROM lk")
def z03(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return NZ.lookup_stats(ev, _ev_stats(ev)).select("sample_id", "k", "mean", "std")


@query("z04_norm_std", f"WITH {EVENTS_SQL}, {_STATS_SQL}, {_LOOKUP_SQL} SELECT sample_id, k, round(CASE WHEN std = 0 "
       "THEN loss_delta - mean ELSE (loss_delta - mean) / std END, 6) AS norm_loss FROM lk")
def z04(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return NZ.lookup_stats(ev, _ev_stats(ev)).select("sample_id", "k", NZ.norm_std().alias("norm_loss"))


@query("z05_norm_linear", f"WITH {EVENTS_SQL}, {_STATS_SQL}, {_LOOKUP_SQL} SELECT sample_id, k, round(CASE WHEN "
       "loss_diff = 0 THEN loss_delta - min_loss ELSE (loss_delta - min_loss) / loss_diff END, 6) AS norm_loss FROM lk")
def z05(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return NZ.lookup_stats(ev, _ev_stats(ev)).select("sample_id", "k", NZ.norm_linear().alias("norm_loss"))


_DELTA_SQL = (
    f"{_L06_CTES}, dn AS (SELECT sample_id, neighbor, min(k) AS k FROM nbrs GROUP BY sample_id, neighbor), "
    "etx AS (SELECT d.sample_id, d.k, d.neighbor || ' ' || s.answer AS text FROM dn d JOIN samples s USING (sample_id) "
    "UNION ALL SELECT sample_id, -1 AS k, input || ' ' || answer AS text FROM samples), "
    f"{_embed_sql('etx', 'sample_id, k')}, "
    "nbv AS (SELECT sample_id, k, dim, value FROM emb WHERE k >= 0), "
    "inv AS (SELECT sample_id, dim, value FROM emb WHERE k = -1), "
    "keys AS (SELECT DISTINCT sample_id, k FROM nbv), "
    "dd AS (SELECT kk.sample_id, kk.k, d.dim, coalesce(n.value, 0.0) - coalesce(i.value, 0.0) AS delta FROM keys kk "
    "CROSS JOIN range(0, 64) d(dim) LEFT JOIN nbv n ON n.sample_id = kk.sample_id AND n.k = kk.k AND n.dim = d.dim "
    "LEFT JOIN inv i ON i.sample_id = kk.sample_id AND i.dim = d.dim), "
    "dl2 AS (SELECT sample_id, k, sqrt(sum(delta * delta)) AS l2 FROM dd GROUP BY ALL), "
    "deltas AS (SELECT l.sample_id, l.k, s.ds_name, l.model_name, l.label, l.neighbor_loss - l.input_loss AS "
    "loss_delta, d.l2 FROM losses l JOIN dl2 d ON d.sample_id = l.sample_id AND d.k = l.k JOIN samples s "
    "ON s.sample_id = l.sample_id)"
)


def _deltas(spark, sf_dir):
    """Lazy; whoever reads the deltas more than once stores them."""
    s = V.samples(spark, sf_dir)
    nb = cut_lineage(N.neighbors(s))  # every later stage reads the neighbours from here
    embeds = stored(EM.embed_vectors(s, nb))
    return DL.build_deltas(s, embeds, _losses(spark, sf_dir, s, nb))


@query("d07_build_deltas", f"WITH {_DELTA_SQL} SELECT sample_id, CAST(k AS BIGINT) AS k, ds_name, model_name, "
       "CAST(label AS BIGINT) AS label, round(loss_delta, 6) AS loss_delta, round(l2, 6) AS embedding_delta_l2 "
       "FROM deltas")
def d07(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    return d.select("sample_id", "k", "ds_name", "model_name", "label", "loss_delta",
                    l2_norm("embedding_delta").alias("embedding_delta_l2"))


@query(
    "z06_assemble",
    f"WITH {_DELTA_SQL}, zs AS (SELECT ds_name, model_name, avg(loss_delta) AS mean, var_pop(loss_delta) AS std "
    "FROM deltas GROUP BY ALL), zf AS (SELECT d.*, CASE WHEN zs.std = 0 THEN d.loss_delta - zs.mean ELSE "
    "(d.loss_delta - zs.mean) / zs.std END AS lf FROM deltas d JOIN zs USING (ds_name, model_name)) "
    "SELECT sample_id, CAST(k AS BIGINT) AS k, model_name, round(lf, 6) AS loss_feature, CAST(65 AS BIGINT) AS "
    "n_features, round(sqrt(lf * lf + l2 * l2), 6) AS features_l2 FROM zf",
)
def z06(spark, sf_dir):
    d = stored(_deltas(spark, sf_dir))
    stats = NZ.loss_mean_var(d)
    out = NZ.assemble(d, "BaseLineLossNormSTD", "std", stats)
    return out.select("sample_id", "k", "model_name", "loss_feature", F.size("features").alias("n_features"),
                      l2_norm("features").alias("features_l2"))


@query(
    "d01_align",
    f"WITH {_DELTA_SQL} SELECT l.model_name, CAST(l.label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n_rows "
    "FROM losses l JOIN keys USING (sample_id, k) GROUP BY ALL",
)
def d01(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    nb = cut_lineage(N.neighbors(s))
    embeds = EM.embed_vectors(s, nb).filter(F.col("k") >= 0)
    return DL.align(embeds, _losses(spark, sf_dir, s, nb)).groupBy("model_name", "label").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query(
    "d01b_unmatched",
    f"WITH {_DELTA_SQL} SELECT 'losses' AS only_in, CAST(count(*) AS BIGINT) AS n FROM (SELECT sample_id, k FROM losses "
    "WHERE model_name = 'ngram-a' EXCEPT SELECT sample_id, k FROM keys)",
)
def d01b(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    nb = cut_lineage(N.neighbors(s))
    embeds = EM.embed_vectors(s, nb).filter(F.col("k") >= 0)
    losses = _losses(spark, sf_dir, s, nb).filter(F.col("model_name") == "ngram-a")
    u = DL.unmatched(embeds, losses)
    return u.groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d02_group_key",
    f"WITH {SAMPLES_SQL} SELECT sample_id, md5(input || '|' || answer || '|' || ds_name || '|' || "
    "CAST(conv_id % 2 AS VARCHAR)) AS group_key FROM samples",
)
def d02(spark, sf_dir):
    s = V.samples(spark, sf_dir).withColumn("label", F.pmod(F.col("conv_id"), F.lit(2)))
    return s.select("sample_id", DL.group_key("input", "answer", "ds_name", "label").alias("group_key"))


@query(
    "d08_legacy_groups",
    f"WITH {SAMPLES_SQL} SELECT sample_id, CAST(dense_rank() OVER (ORDER BY input, conv_id % 2) - 1 AS BIGINT) "
    "AS group_idx FROM samples",
)
def d08(spark, sf_dir):
    s = V.samples(spark, sf_dir).withColumn("label", F.pmod(F.col("conv_id"), F.lit(2)))
    return DL.legacy_groups(s).select("sample_id", "group_idx")


# --------------------------------------------------------------------------- modality branch
_SPECS_SQL = (
    "nn AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, row_number() OVER (PARTITION BY sample_id ORDER BY k) - 1 "
    "AS pos FROM nbrs), ml AS (SELECT sample_id, 'media/' || CAST(sample_id * 13 % 520 AS VARCHAR) AS base, conv_id % 3 AS mkind "
    "FROM samples), specs AS (SELECT nn.sample_id, neighbor, k, 'media/' || CAST((nn.sample_id * 7 + pos) % 520 AS VARCHAR) AS path "
    "FROM nn JOIN ml USING (sample_id) WHERE mkind = 0 UNION ALL SELECT nn.sample_id, neighbor, min(k), base FROM nn "
    "JOIN ml USING (sample_id) WHERE mkind <> 0 GROUP BY nn.sample_id, neighbor, base), "
    "mf AS (SELECT 'media/' || CAST(vec_id AS VARCHAR) AS path, embedding AS v FROM embeddings)"
)
_MODALITY_SQL = (
    f"{_SPECS_SQL}, md AS (SELECT sp.sample_id, sp.k, a.v AS nv, b.v AS iv FROM specs sp JOIN ml USING (sample_id) "
    "LEFT JOIN mf a ON a.path = sp.path LEFT JOIN mf b ON b.path = ml.base), "
    "mdd AS (SELECT sample_id, k, d.dim, CAST(nv[d.dim + 1] AS DOUBLE) - CAST(iv[d.dim + 1] AS DOUBLE) AS delta FROM md, "
    "range(0, 64) d(dim) WHERE nv IS NOT NULL AND iv IS NOT NULL)"
)


def _aligned(spark, sf_dir, s, nb):
    """Neighbours aligned with their media, and media deltas."""
    media = V.media_lists(s, nb)
    specs = EM.explode_neighbors(nb, media=media)
    vectors = EM.media_vectors(specs, media, V.media_files(spark, sf_dir))
    return specs, DL.modality_deltas(vectors, "image")


@query("e01b_aligned_media", f"WITH {NEIGHBORS_SQL}, {_SPECS_SQL} SELECT sample_id, CAST(k AS BIGINT) AS k, neighbor, path FROM specs")
def e01b(spark, sf_dir):
    """Neighbours zipped with their own media where the lists have one length, else distinct with the base path."""
    s = V.samples(spark, sf_dir)
    nb = cut_lineage(N.neighbors(s))
    return EM.explode_neighbors(nb, media=V.media_lists(s, nb)).select("sample_id", "k", "neighbor", "path")


@query("d05_modality_delta", f"WITH {NEIGHBORS_SQL}, {_MODALITY_SQL} SELECT sample_id, CAST(k AS BIGINT) AS k, "
       "CAST(dim AS BIGINT) AS dim, round(delta, 6) AS delta FROM mdd UNION ALL SELECT sample_id, CAST(k AS BIGINT), NULL, NULL "
       "FROM md WHERE nv IS NULL OR iv IS NULL")
def d05(spark, sf_dir):
    """Every entry of the media delta of every neighbour; one row of nulls where a side has no vector."""
    s = V.samples(spark, sf_dir)
    _, deltas = _aligned(spark, sf_dir, s, cut_lineage(N.neighbors(s)))
    return deltas.select("sample_id", "k", F.posexplode_outer("image_delta").alias("dim", "delta"))


_DISTINCT_SQL = "dn AS (SELECT sample_id, neighbor, min(k) AS k FROM nbrs GROUP BY sample_id, neighbor), "
_MODAL_DELTA_SQL = _DELTA_SQL.replace(_DISTINCT_SQL, f"{_MODALITY_SQL}, dn AS (SELECT sample_id, neighbor, k FROM specs), ")


def _modal_deltas(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    nb = cut_lineage(N.neighbors(s))
    specs, deltas = _aligned(spark, sf_dir, s, nb)
    embeds = stored(EM.embed_vectors(s, nb, specs=specs))
    return stored(DL.build_deltas(s, embeds, _losses(spark, sf_dir, s, nb), modality=deltas))


@query(
    "z06b_assemble_modality",
    f"WITH {_MODAL_DELTA_SQL}, zs AS (SELECT ds_name, model_name, min(loss_delta) AS lo, max(loss_delta) - min(loss_delta) "
    "AS diff FROM deltas GROUP BY ALL), zf AS (SELECT d.*, CASE WHEN diff = 0 THEN d.loss_delta - lo ELSE (d.loss_delta - lo) / "
    "diff END AS lf FROM deltas d JOIN zs USING (ds_name, model_name)), "
    "tsum AS (SELECT sample_id, k, sum((dim + 2) * delta) AS t FROM dd GROUP BY ALL), "
    "msum AS (SELECT sample_id, k, sum((dim + 66) * delta) AS m FROM mdd GROUP BY ALL) "
    "SELECT zf.sample_id, CAST(zf.k AS BIGINT) AS k, model_name, round(lf, 6) AS loss_feature, CAST(129 AS BIGINT) AS n_features, "
    "round(lf + t + coalesce(m, 0), 5) AS weighted_sum FROM zf JOIN tsum USING (sample_id, k) LEFT JOIN msum USING (sample_id, k)",
)
def z06b(spark, sf_dir):
    """Loss (scaled to its group's range), text delta and media delta in one vector; the sum of its entries times their places."""
    d = _modal_deltas(spark, sf_dir)
    out = NZ.assemble(d, "ModalityAllLossNormLinear", "linear", NZ.loss_min_range(d), modality_dim=64)
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", "k", "model_name", "loss_feature", F.size("features").alias("n_features"),
                      F.round(weighted, 5).alias("weighted_sum"))


@query(
    "l02b_score_loss_whole",
    f"WITH {SAMPLES_SQL}, {_lm_sql('lma', 'true')}, tx AS (SELECT sample_id, input || ' ' || answer AS text "
    f"FROM samples), {_score_sql('sc', 'lma', 'tx', 'sample_id')} SELECT sample_id, round(loss, 6) AS loss FROM sc",
)
def l02b(spark, sf_dir):
    """Loss under the bigram model of all documents."""
    s = V.samples(spark, sf_dir).select("sample_id", F.concat_ws(" ", "input", "answer").alias("text"))
    return LO.score_loss(s, ["sample_id"], "text", LO.train_bigram_lm(table(spark, sf_dir, "documents")))


@query(
    "d01c_unmatched_by_model",
    f"WITH {_DELTA_SQL} SELECT model_name, CAST(count(*) AS BIGINT) AS n FROM losses l WHERE NOT EXISTS (SELECT 1 FROM keys kk "
    "WHERE kk.sample_id = l.sample_id AND kk.k = l.k) GROUP BY model_name",
)
def d01c(spark, sf_dir):
    """Loss rows without an embedding, for every model."""
    s = V.samples(spark, sf_dir)
    nb = cut_lineage(N.neighbors(s))
    embeds = EM.embed_vectors(s, nb).filter(F.col("k") >= 0)
    left = _losses(spark, sf_dir, s, nb).join(embeds.select("sample_id", "k"), ["sample_id", "k"], "left_anti")
    return left.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))


def _media_samples(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return s.withColumn("modality", F.when(F.pmod("conv_id", F.lit(5)) == 0,
                                           F.concat(F.lit("media/conv"), F.col("conv_id").cast("string"), F.lit("/clip")))
                        .otherwise(F.concat(F.lit("media/conv"), F.col("conv_id").cast("string"), F.lit("/clip.wav"))))


@query(
    "n10_modality_neighbors",
    f"WITH {NEIGHBORS_SQL}, ms AS (SELECT sample_id, CASE WHEN conv_id % 5 = 0 THEN 'media/conv' || "
    "CAST(conv_id AS VARCHAR) || '/clip' ELSE 'media/conv' || CAST(conv_id AS VARCHAR) || '/clip.wav' END AS p "
    "FROM samples), mf AS (SELECT sample_id, regexp_extract(p, '[^/]*$', 0) AS fname FROM ms), "
    "mx AS (SELECT sample_id, fname, regexp_extract(fname, '^.+(\\.[^.]*)$', 1) AS ext FROM mf) "
    "SELECT n.sample_id, CAST(n.k AS BIGINT) AS k, printf('%s/%s_row%d_n%d%s', 'modality_neighbors', "
    "CASE WHEN ext = '' THEN fname ELSE substring(fname, 1, length(fname) - length(ext)) END, n.sample_id, n.k, "
    "CASE WHEN ext = '' THEN '.bin' ELSE ext END) AS modality_neighbor FROM nbrs n JOIN mx USING (sample_id)",
)
def n10(spark, sf_dir):
    s = _media_samples(spark, sf_dir)
    return N.modality_neighbor_paths(N.neighbors(s), s, "modality_neighbors")


def _chat_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text_el = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"),
                       F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("video"))
    img = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"),
                   F.format_string("images/c%d_t%d.png", "conv_id", "turn").alias("image"),
                   F.lit(None).cast("string").alias("video"))
    vid = F.struct(F.lit("video").alias("type"), F.lit(None).cast("string").alias("text"),
                   F.lit(None).cast("string").alias("image"),
                   F.format_string("videos/c%d.mp4", "conv_id").alias("video"))
    with_img = (F.col("role") == "user") & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0)
    with_vid = (F.col("role") == "assistant") & (F.pmod(F.col("conv_id"), F.lit(4)) == 0)
    empty = F.array().cast("array<struct<type:string,text:string,image:string,video:string>>")
    content = F.concat(F.when(with_img, F.array(img)).otherwise(empty), F.array(text_el),
                       F.when(with_vid, F.array(vid)).otherwise(empty))
    return c.select("conv_id", "turn", "role", content.alias("content"))


@query(
    "l07_media_refs",
    "WITH m AS (SELECT conv_id, turn, (role = 'user' AND (conv_id + turn) % 3 = 0) AS wi, "
    "(role = 'assistant' AND conv_id % 4 = 0) AS wv FROM conversations) "
    "SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'image' AS kind, printf('images/c%d_t%d.png', conv_id, turn) "
    "AS ref FROM m WHERE wi UNION ALL SELECT conv_id, turn, CAST(CASE WHEN wi THEN 2 ELSE 1 END AS BIGINT), 'video', "
    "printf('videos/c%d.mp4', conv_id) FROM m WHERE wv",
)
def l07(spark, sf_dir):
    return LO.media_refs(_chat_messages(spark, sf_dir))
