"""Counters of a running extraction, observed while the rows pass by, so they cost no job of their own."""

from __future__ import annotations

from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, functions as F


def _seen(observation: Observation) -> dict[str, int]:
    """What was observed; all zero where Spark found the rows to be none and left the observation out of the plan."""
    try:
        return observation.get
    except Py4JJavaError as error:
        if "assertion failed" not in str(error):
            raise
        return defaultdict(int)


class Progress:
    """How many texts arrived, how many gave no phrase, and how many phrases were chosen, in one extraction.

    Pass it to `phrase_counts`; `counters` waits for the action that runs the extraction.
    """

    def __init__(self):
        self._arrived, self._chosen = Observation(), Observation()

    def texts(self, corpus: DataFrame) -> DataFrame:
        return corpus.observe(self._arrived, F.count(F.lit(1)).alias("texts"), F.count_if(F.col("text").isNull()).alias("missing_texts"))

    def phrases(self, chosen: DataFrame) -> DataFrame:
        return chosen.observe(self._chosen, F.count_if(F.col("rank") == 1).alias("with_phrases"), F.count(F.lit(1)).alias("phrases"))

    def counters(self) -> dict[str, int]:
        arrived, chosen = _seen(self._arrived), _seen(self._chosen)
        return {"texts": arrived["texts"], "missing_texts": arrived["missing_texts"],
                "texts_without_phrases": arrived["texts"] - chosen["with_phrases"], "phrases": chosen["phrases"]}
