"""A whole run: detector tables in, the decision list out."""

from __future__ import annotations

import logging
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Pattern
from ..operators.cluster import density_clusters
from ..operators.decisions import appended, merge_overlapping, pad, renumbered
from ..operators.dialogue import scan_lines, scan_words
from ..operators.snap import snap
from ..operators.support import mark_unsupported
from ..schema import DECISION_COLUMNS, MEDIA
from ..settings import Settings

log = logging.getLogger(__name__)


@dataclass
class Inputs:
    """Tables of a run. Detector tables hold decisions; None: that detector didn't run."""

    cues: DataFrame
    words: DataFrame | None = None
    shots: DataFrame | None = None
    visual: DataFrame | None = None
    llm: DataFrame | None = None
    audio: DataFrame | None = None
    vlm: DataFrame | None = None
    lexicon: list[Pattern] = field(default_factory=list)
    replacements: dict[str, str] = field(default_factory=dict)


def checkpoint_folder(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one on a local master where that is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="spanforge-"))
    return context._jsc.sc().getCheckpointDir().get()


def or_nothing(make: Callable[[], DataFrame], like: DataFrame, what: str) -> DataFrame:
    """A detector's rows, checkpointed so that its errors show here; none, and a warning, if it fails. A missing checkpoint folder isn't the detector's fault, and is an error."""
    checkpoint_folder(like.sparkSession)
    try:
        return make().checkpoint(eager=True)
    except Exception:
        log.warning("%s failed; going on without it", what, exc_info=True)
        return like.where("false")


def build_edl(x: Inputs, s: Settings) -> DataFrame:
    """Dialogue and pictures, padded and merged; then model, audio and density rows; then vision rows; merged, snapped, merged and corroborated.

    An item with word timings is scanned by words, any other by its cues.
    """
    lexicon = [p for p in x.lexicon if p.category in s.enabled]
    cues = x.cues
    if x.words is not None:
        cues = cues.join(x.words.select(MEDIA).distinct(), MEDIA, "left_anti")
    edl = scan_lines(cues, lexicon, s.actions, x.replacements, s.context_window)
    if x.words is not None:
        edl = appended(edl, scan_words(x.words, lexicon, s.actions, x.replacements, s.context_window))
    if x.visual is not None:
        edl = appended(edl, x.visual)
    edl = merge_overlapping(pad(edl, s.pad), s.merge_gap)  # merged rows are numbered in order
    for on, rows in ((s.llm, x.llm), (s.audio, x.audio)):
        if on and rows is not None:
            edl = appended(edl, rows)
    if s.density:
        # the list is read twice from here, by the clusters and by what they are appended to
        checkpoint_folder(edl.sparkSession)
        edl = edl.checkpoint()
        dense = density_clusters(edl, s.density_window, s.density_events, s.density_span)
        rows = dense.withColumns({"seq": F.lit(0).cast("bigint"), "action": F.lit("cut"), "text_before": F.lit(""), "text_after": F.lit(""), "source": F.lit("density"), "accepted": F.lit(True)})
        edl = appended(edl, renumbered(rows).select(DECISION_COLUMNS))
    if s.vlm and x.vlm is not None:
        edl = appended(edl, x.vlm)
    edl = merge_overlapping(edl, s.merge_gap)
    if s.snap and x.shots is not None:
        edl = merge_overlapping(snap(edl, x.shots), 0.0)
    return mark_unsupported(edl, s.corroborate_radius) if s.corroborate else edl
