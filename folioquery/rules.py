"""Fixed values and tunable defaults, kept together so nothing hides in code.

The first group must stay as it is for results to agree with existing corpora
and queries. The second group is ours: defaults of parameters every caller can
override.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Engine codes, other names of the same motor, and the valve
# count printed on a diagram that ties it to one motor.
# ---------------------------------------------------------------------------
ENGINE_CODES = ("D4F", "H4M", "K4M", "K7M", "K9K")
ENGINE_ALIASES = {"HR16DE": "H4M"}
VALVE_COUNT_ENGINES = {"8V": "K7M", "16V": "K4M"}

# ---------------------------------------------------------------------------
# The words printed in a citation and in warnings.
# ---------------------------------------------------------------------------
CITATION_SEPARATOR = " — "
PAGE_LABEL = "PDF-стр."
PART_LABEL = "фрагмент"
PART_OF_LABEL = "из"
IMAGE_LABEL = "иллюстрация"
ALARM_WORD = "ВНИМАНИЕ"
NOT_APPLICABLE_WORD = "неприменим"

# ---------------------------------------------------------------------------
# Line shapes of the two page layouts. Repeated groups are
# possessive (``*+``): Java then loops instead of recursing, so a line or token
# of any length is safe.
# ---------------------------------------------------------------------------
PAGE_LABEL_LINE = r"^\d+\.\d+$"
HEADING_LINE = r"^\p{Lu}[\p{Lu}\p{N} ,./-]{3,}(?:\([^)]*\) ?)*+(?::.*)?$"
PRINTER_COLOUR_LINE = r"^Jaune\b.*\bNoir\b.*$"
LAYOUT_ID_LINE = r"^[A-Z]{3}_[A-Z]{2}[A-Za-z0-9_-]*\d[A-Za-z0-9_-]*$"
FOREIGN_HEADING_LINE = r"\(X\d\d Ph\d - \p{L}+\)$"
CALLOUT_LINE = r"^\d{1,2}(?: +\d{1,2})++$|^\d$"
CONTINUATION_COUNTER = r" *\(\d+/\d+\) *$"
STEP_LINE = r"^- (\d+) -$"
STYLESHEET_LINE = r"^XSL version\b.*$"
XML_NAME_LINE = r"^[A-Za-z0-9-]*\d+x\d+[A-Za-z0-9-]*\.xml$"
SYSTEM_CODE = r"\((\d{2}[A-Z], [^)]+)\)"
TORQUE_VALUE = r"\d+(?:[.,]\d+)? *(?:N[.·⋅]? ?m|Н[.·⋅]? ?м)(?:[^\p{L}\p{N}_]|$)"

# ---------------------------------------------------------------------------
# Tokens: decimals, then words with inner hyphens.
# ---------------------------------------------------------------------------
TOKEN = r"\p{N}+(?:\.\p{N}+)++|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*+"
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+$"

# ---------------------------------------------------------------------------
# Our defaults (parameters).
# ---------------------------------------------------------------------------
STOP_WORDS = (
    "а", "в", "во", "где", "делать", "для", "до", "же", "за", "и", "из", "или",
    "к", "как", "какая", "какие", "какой", "какое", "ли", "на", "не", "о", "об",
    "от", "по", "при", "с", "со", "у", "что", "это",
    "a", "an", "and", "at", "for", "how", "in", "is", "of", "on", "or", "the",
    "to", "what", "where", "which", "with",
)
TORQUE_STEMS = ("момент", "затяжк", "torqu", "tighten")
TIMING_WORD = r"\b(?:грм|timing)\b"
BELT_WORD = r"\b(?:ремень|ремн\w+|belts?)\b"
CHAIN_WORD = r"\b(?:цепь|цепью|цепи|цепей|цепям|цепями|цепях|chains?)\b"
MIN_CHUNK_CHARS = 40
TITLE_SEPARATOR = " / "
PATH_SEPARATOR = " > "
CHUNK_TARGET = 1300


@dataclass(frozen=True)
class SearchParams:
    """Ranking constants; every one is a parameter with a documented default."""

    k1: float = 1.2
    b: float = 0.75
    synonym_weight: float = 0.9
    title_bonus: float = 1.0
    proximity_window: int = 8
    proximity_bonus: float = 0.25
    # "pairs": each two neighbouring concepts within the window count; "cover": one
    # stretch with all concepts, at most a window long for each step between them.
    proximity: str = "pairs"
    torque_bonus: float = 0.25
    coverage: str = "strict"  # or "soft"
    fuzzy: bool = True
    fuzzy_threshold: float = 0.3
    stop_words: tuple[str, ...] = STOP_WORDS
    torque_stems: tuple[str, ...] = TORQUE_STEMS
    # A query side of at most this many rows is broadcast; beyond it the join
    # with the postings is a salted shuffle join.
    broadcast_rows: int = 20000
    salts: int = 16
    # Questions whose terms have more postings than this look at block bounds first and
    # score only blocks that can reach the hit list; first_blocks set the threshold.
    prune_from: int = 1_000_000
    first_blocks: int = 16
