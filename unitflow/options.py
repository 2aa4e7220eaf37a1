"""Fixed values of the data model and the options of a translation job."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from unitflow.operators.detector import Profile

# --- Fixed values: results depend on these being exactly as they are ---------------------------
ENGLISH = "eng_Latn"
RUSSIAN = "rus_Cyrl"
SUPPORTED_SOURCES = (ENGLISH, RUSSIAN)
DEFAULT_TARGET = "uzn_Latn"

KIND_PARAGRAPH = "docx_para"
KIND_SPAN = "pdf_span"

VOTE_HEAD = 50  # units that vote for a document's source language
FILE_HEAD = 5  # lines that decide a line file's source language
PREVIEW_ROWS = 80
PREVIEW_EXTRACT_CHARS = 300
PREVIEW_RESULT_CHARS = 200

DEFAULT_FONT_SIZE = 11.0
MIN_FONT_SIZE = 4.0

PAGE_HEADING = "Sahifa "
PROGRESS_LABEL = "Tarjima: "
OUTPUT_SUFFIX = "_uz"
SIDE_BY_SIDE_ARROW = "→"

FORMATS = ("docx", "pdf")
MIME_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pdf": "application/pdf",
}
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    """Settings of one job.

    source        'auto' (or None / '') detects, otherwise one of SUPPORTED_SOURCES
    target        target code handed to the translator, never validated
    batch_size    most texts per translator call
    beam_size     handed to the translator factory
    output_format 'auto', 'docx' or 'pdf'
    mode          'vote': one source per document; 'per_unit': each unit on its own
    dedup         translate each distinct (text, source) once and join the result back
    max_chars     units longer than this are flagged ``over_limit`` (never cut)
    split_chars   units longer than this are translated in pieces that end at sentences, and joined again
    batch_tokens  most estimated tokens of a call, counted as texts x the longest; fills batches by length
    on_error      'fail': a failing call ends the job; 'row': the text that fails becomes a row with ``error``
    memory        a folder of what earlier runs and batches have translated (``operators.memory``)
    profiles      a detector (``operators.detector.load_profile``) that decides where script alone does not
    vote_head     units that vote for a document's source language
    part_units    most paragraphs in one part of a document's text
    """

    source: str | None = "auto"
    target: str = DEFAULT_TARGET
    batch_size: int = 32
    beam_size: int = 1
    output_format: str = "auto"
    mode: str = "vote"
    dedup: bool = True
    max_chars: int | None = None
    split_chars: int | None = None
    batch_tokens: int | None = None
    on_error: str = "fail"
    memory: str | None = None
    profiles: Profile | None = field(default=None, compare=False)
    vote_head: int = VOTE_HEAD
    part_units: int = 4096

    def __post_init__(self):
        pinned_source(self.source)
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.vote_head < 1 or self.part_units < 1:
            raise ValueError("vote_head and part_units must be at least 1")
        if self.split_chars is not None and self.split_chars < 2:
            raise ValueError("split_chars must be at least 2")
        if self.batch_tokens is not None and self.batch_tokens < 1:
            raise ValueError("batch_tokens must be at least 1")
        if self.on_error not in ("fail", "row"):
            raise ValueError("on_error must be 'fail' or 'row'")
        if self.mode not in ("vote", "per_unit"):
            raise ValueError("mode must be 'vote' or 'per_unit'")
        if (self.output_format or "auto").lower() not in ("auto", *FORMATS):
            raise ValueError("output_format must be auto, docx or pdf")


def pinned_source(source: str | None) -> str | None:
    """The pinned source code, or None when the source is to be detected."""
    if source in (None, "", "auto"):
        return None
    if source not in SUPPORTED_SOURCES:
        raise ValueError(
            f"unsupported source {source!r}: use auto, " + " or ".join(SUPPORTED_SOURCES)
        )
    return source
