"""All six blind detectors by name (H43): one dispatch by data set, true and permuted labels, one tidy result.

Every detector gives rows ``(attack, task, metric, mean, std)``. ``task`` is
``original`` or ``permuted``; the permuted labels come from one control table
for each set of ids, so all detectors of a modality see the same control.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bow_attack as B
from tidemark.operators import dates as D
from tidemark.operators import greedy as G
from tidemark.operators import metrics as M
from tidemark.operators.folds import permute_labels
from tidemark.operators.media_attack import joint_attack, media_attack
from tidemark.session import cut_lineage

TASKS = ("original", "permuted")


@dataclass(frozen=True)
class Corpus:
    """What the detectors read; a detector whose input is None can't be run.

    ``docs``: ``(doc_id, text, label)``; ``images``, ``audio``: ``(id, features, label)`` with ``array<double>``
    features; ``doc_media``: ``(doc_id, features)``, the media vector of each document.
    """

    docs: DataFrame | None = None
    images: DataFrame | None = None
    audio: DataFrame | None = None
    doc_media: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    dataset_name: str = "custom"
    fpr_budget_pct: float = 1.0
    cutoff: int | None = None
    media_model: str = "stack"
    greedy_splits: int = 10
    pca_dim: int | None = 250
    seed: int = 42

    @property
    def tpr(self) -> str:
        return f"tpr_at_{M._pct_name(self.fpr_budget_pct)}fpr"


def _summary(attack: str, task: str, row: DataFrame, metrics: Mapping[str, tuple]) -> DataFrame:
    """Tidy rows from a one-row table: ``metrics`` maps a name to its mean and standard deviation columns."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(attack).alias("attack"), F.lit(task).alias("task"), F.lit(name).alias("metric"),
                 mean.cast("double").alias("mean"), std.cast("double").alias("std")) for name, (mean, std) in metrics.items()])))


def _both_labels(one: Callable[[DataFrame, str, Settings], DataFrame], attack: str):
    """A detector of ``(doc_id, text, label)`` run on the true labels and on the control's."""

    def run(data: Corpus, s: Settings) -> DataFrame:
        control = cut_lineage(permute_labels(data.docs.select("doc_id", "label"), "doc_id", "label", s.seed))
        out = one(data.docs, "original", s)
        return out.unionByName(one(data.docs.drop("label").join(control, "doc_id"), "permuted", s))

    return attack, run


def _dates(docs: DataFrame, task: str, s: Settings) -> DataFrame:
    if s.dataset_name == "arxiv_1m":  # years of citations instead of years of the text
        preds = D.cite_date_detection(docs, s.cutoff or D.ARXIV_CUTOFF)
    else:
        preds = D.date_detection(docs, cutoff=s.cutoff or D.DATASET_CUTOFFS.get(s.dataset_name, D.DEFAULT_CUTOFF))
    rep = D.detection_report(preds, s.fpr_budget_pct)
    return _summary("date_detection", task, rep, {n: (F.col(n), F.lit(0.0)) for n in ("auroc", s.tpr, "no_year_count")})


def _greedy(docs: DataFrame, task: str, s: Settings) -> DataFrame:
    attack, spread = "greedy_selection", lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0))
    if s.dataset_name == "temporal_wiki":
        per = G.greedy_wiki(docs, cross_vals=s.greedy_splits, seed=s.seed).agg(F.avg("best_auc").alias("m"), spread("best_auc").alias("s"))
        return _summary(attack, task, per, {"auroc": (F.col("m"), F.col("s"))})
    if s.dataset_name == "arxiv1m_1m":  # fixed trigger words on the held-out head of each class
        clean = G.clean_corpus(docs)
        head = G.head_split(clean, G.head_size(clean)).filter("is_test")
        rates = [G.trigger_rate(head, words).select(F.lit(name).alias("name"), "tpr", "fpr")
                 for name, words in (("reference_words", G.REFERENCE_WORDS), ("best_words", G.BEST_WORDS))]
        both = rates[0].unionByName(rates[1])
        row = both.agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{c}") for n in ("reference_words", "best_words") for c in ("tpr", "fpr")])
        return _summary(attack, task, row, {c: (F.col(c), F.lit(0.0)) for c in row.columns})
    per = G.greedy_basic(docs, s.fpr_budget_pct, cross_vals=s.greedy_splits, seed=s.seed)
    row = per.agg(F.coalesce(F.avg("best_tpr"), F.lit(0.0)).alias("m"), spread("best_tpr").alias("s"))  # of splits over the budget
    return _summary(attack, task, row, {s.tpr: (F.col("m"), F.col("s"))})


def _words(data: Corpus, s: Settings) -> DataFrame:
    return B.bag_of_words_attack(data.docs, s.dataset_name, s.fpr_budget_pct, seed=s.seed)


def _media(attack: str, part: str, reduced: bool):
    def run(data: Corpus, s: Settings) -> DataFrame:
        return media_attack(getattr(data, part), attack, s.media_model, s.fpr_budget_pct, "id", seed=s.seed,
                            pca_dim=s.pca_dim if reduced else None)

    return attack, run


def _joint(docs: DataFrame, media: DataFrame, task: str, s: Settings) -> DataFrame:
    per = joint_attack(docs, media, s.fpr_budget_pct, model_type=s.media_model, seed=s.seed)
    row = M.fold_summary(per, ["auroc", "tpr"])
    return _summary("joint_text_modality", task, row, {
        "auroc": (F.col("auroc_mean"), F.col("auroc_std")), s.tpr: (F.col("tpr_mean"), F.col("tpr_std"))})


def _joint_both(data: Corpus, s: Settings) -> DataFrame:
    docs = data.docs.join(data.doc_media.select("doc_id"), "doc_id", "left_semi")
    control = cut_lineage(permute_labels(docs.select("doc_id", "label"), "doc_id", "label", s.seed))
    return _joint(docs, data.doc_media, "original", s).unionByName(
        _joint(docs.drop("label").join(control, "doc_id"), data.doc_media, "permuted", s))


DETECTORS: dict[str, Callable[[Corpus, Settings], DataFrame]] = dict([
    _both_labels(_dates, "date_detection"), ("bag_of_words", _words), _both_labels(_greedy, "greedy_selection"),
    _media("bag_of_visual_words", "images", True), _media("bag_of_audio_words", "audio", False), ("joint_text_modality", _joint_both)])
NEEDS = {"date_detection": ("docs",), "bag_of_words": ("docs",), "greedy_selection": ("docs",), "bag_of_visual_words": ("images",),
         "bag_of_audio_words": ("audio",), "joint_text_modality": ("docs", "doc_media")}


def run_attacks(data: Corpus, attacks: Sequence[str] = tuple(DETECTORS), settings: Settings = Settings()) -> DataFrame:
    """``(attack, task, metric, mean, std)`` of the named detectors; an unknown name or a missing input is an error."""
    out = None
    for attack in attacks:
        if attack not in DETECTORS:
            raise ValueError(f"no detector is named {attack!r}; there are {', '.join(DETECTORS)}")
        lacking = [n for n in NEEDS[attack] if getattr(data, n) is None]
        if lacking:
            raise ValueError(f"{attack} needs {' and '.join(lacking)}")
        part = DETECTORS[attack](data, settings).select("attack", "task", "metric", "mean", "std")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("name one detector or more")
    return out
