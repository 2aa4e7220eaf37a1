"""What happens between a batch of texts and the translator: segments, batches, failing calls. No Spark here."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import batched, groupby

from unitflow.functions.text import SENTENCE_ENDS, WHITESPACE
from unitflow.options import Options

CHARS_PER_TOKEN = 4  # a text is taken for this many characters a token, and one token more

Translator = Callable[[list[str], str, str], Sequence[str]]


@lru_cache
def _segment(chars: int) -> re.Pattern:
    space, end = re.escape(WHITESPACE), re.escape(SENTENCE_ENDS)
    ways = [f".{{1,{chars}}}\\Z", f".{{0,{chars - 2}}}[{end}][{space}]", f".{{0,{chars - 1}}}[{space}]"]
    return re.compile("|".join([*ways, f".{{1,{chars}}}"]), re.DOTALL)


def segments_of(text: str, chars: int) -> list[str]:
    """Cut a text into pieces of up to ``chars`` characters that together are the text.

    A piece goes as far as it can to a sentence's end and the white space behind it, else to a white space, else
    to its last character.
    """
    return _segment(chars).findall(text) if len(text) > chars else [text]


def estimated_tokens(text: str) -> int:
    return len(text) // CHARS_PER_TOKEN + 1


def cut_batches(texts: Sequence[str], options: Options) -> Iterator[list[int]]:
    """Places in ``texts``, batch by batch: in order, or by length where ``batch_tokens`` bounds a batch.

    A batch costs as many tokens as its longest text has, for every text. Texts of near lengths go together, and a batch
    ends before rows x longest passes the budget; a single text that is longer goes alone.
    """
    if options.batch_tokens is None:
        yield from (list(part) for part in batched(range(len(texts)), options.batch_size))
        return
    batch: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (len(texts[i]), i)):
        # lengths ascend, so this text would be the batch's longest
        full = len(batch) >= options.batch_size
        if batch and (full or (len(batch) + 1) * estimated_tokens(texts[i]) > options.batch_tokens):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def _called(
    fn: Translator, texts: list[str], source: str, options: Options
) -> list[tuple[str, str | None]]:
    """(translation, error) of each text; a failing call is halved until the text that fails is alone."""
    try:
        done = list(fn(texts, source, options.target))
    except Exception as e:
        if options.on_error == "fail":
            raise
        if len(texts) == 1:
            return [("", f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _called(fn, texts[:half], source, options) + _called(fn, texts[half:], source, options)
    if len(done) != len(texts):
        raise ValueError(f"translator returned {len(done)} texts for {len(texts)}")
    return [(text, None) for text in done]


def translate_texts(
    texts: Sequence[str], sources: Sequence[str], fn: Translator, options: Options
) -> list[tuple[str, str | None]]:
    """(translation, error) in the order given: calls of one source, empty in, empty out."""
    out: list[tuple[str, str | None]] = [("", None)] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t), key=sources.__getitem__)
    for source, same in groupby(order, key=sources.__getitem__):
        places = list(same)
        for batch in cut_batches([texts[i] for i in places], options):
            part = [places[k] for k in batch]
            for i, result in zip(part, _called(fn, [texts[i] for i in part], source, options), strict=True):
                out[i] = result
    return out


def translate_long(
    texts: Sequence[str], sources: Sequence[str], fn: Translator, options: Options
) -> list[tuple[str, str | None, int]]:
    """(translation, error, segments): texts beyond ``split_chars`` go through the translator piece by piece.

    A piece's white space stays around its translation. A text of which a piece fails has no translation, and the first
    piece's error.
    """
    if options.split_chars is None:
        return [(*r, 1 if t else 0) for r, t in zip(translate_texts(texts, sources, fn, options), texts, strict=True)]
    pieces: list[str] = []
    codes: list[str] = []
    counts: list[int] = []
    for text, source in zip(texts, sources, strict=True):
        own = segments_of(text, options.split_chars) if text else []
        pieces += own
        codes += [source] * len(own)
        counts.append(len(own))
    cores = [p.strip(WHITESPACE) for p in pieces]
    done = translate_texts(cores, codes, fn, options)
    out, at = [], 0
    for n in counts:
        joined, error = [], None
        for piece, core, (text, failed) in zip(
            pieces[at : at + n], cores[at : at + n], done[at : at + n], strict=True
        ):
            error = error or failed
            lead = len(piece) - len(piece.lstrip(WHITESPACE))
            # a piece of white space alone is its own translation
            joined.append(piece[:lead] + text + piece[lead + len(core) :] if core else piece)
        out.append(("" if error else "".join(joined), error, n))
        at += n
    return out


def translate_batch(
    texts: Sequence[str], sources: Sequence[str], fn: Translator, options: Options
) -> list[str]:
    """The translations alone."""
    return [text for text, _ in translate_texts(texts, sources, fn, options)]
