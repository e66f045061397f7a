"""Parameters of every stage; the defaults are the values the results depend on."""

from __future__ import annotations

from dataclasses import asdict, dataclass
import hashlib
import json

# Extraction, clustering, sampling and classification constants.
TOP_K_EXTRACT = 3
TOP_K_INFER = 5
MAX_NGRAM = 4
RELEVANT_BOOST = 1.2
INFER_DIVERSITY = 0.7
MIN_PHRASE_FREQUENCY = 3
BAND_HIGH = 0.66
BAND_LOW = 0.33
KMEANS_K = 10
KMEANS_ITERATIONS = 20
ELBOW_K = range(2, 16)
ELBOW_ITERATIONS = 10
SEED = 42
TEST_FRACTION = 0.2
SAMPLE_FRACTION = 0.1
TEXT_NEIGHBOURS = 10
PHRASE_NEIGHBOURS = 5
PHRASE_THRESHOLD = 0.50
LOW_CONFIDENCE = 0.6
# (top similarity below, ratio threshold); the last entry holds for everything above.
ADAPTIVE_THRESHOLDS = ((0.50, 0.85), (0.65, 0.80), (0.80, 0.75), (0.90, 0.70), (None, 0.65))

# Ours: width of the default hashed embedding.
EMBEDDING_DIM = 256


@dataclass(frozen=True)
class ExtractProfile:
    """How key phrases are chosen for one text."""

    top_k: int
    min_chars: int
    banded: bool                # n-gram limit follows the word count
    boost: float | None         # factor for phrases holding a relevant word
    diversity: float | None     # None: plain ranking; else maximal marginal relevance


# Corpus extraction and classification use different settings on purpose.
EXTRACT = ExtractProfile(TOP_K_EXTRACT, 3, True, RELEVANT_BOOST, None)
INFER = ExtractProfile(TOP_K_INFER, 1, False, None, INFER_DIVERSITY)


@dataclass(frozen=True)
class Settings:
    """Parameters of a whole run; hashed into every stage manifest."""

    min_frequency: int = MIN_PHRASE_FREQUENCY
    dim: int = EMBEDDING_DIM
    k: int = KMEANS_K
    iterations: int = KMEANS_ITERATIONS
    seed: int = SEED
    text_neighbours: int = TEXT_NEIGHBOURS
    phrase_neighbours: int = PHRASE_NEIGHBOURS

    def digest(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()
