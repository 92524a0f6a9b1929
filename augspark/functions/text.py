"""Text columns: cleaning, truncation, extraction of model output, label decoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# End markers written by chat models, and the marker in front of a completion.
END_OF_MESSAGE = "<|im_end|>"
END_OF_TURN = "<|eot_id|>"
COMPLETION_MARKER = "Augmented: "

# How a user mention is masked in the source data and what it is replaced by.
USER_MASK = "USERNAME"
USER_MASK_REPLACEMENT = "某人"

MAX_INPUT_CHARS = 500

# All characters that Python's str.strip() removes; the last one is the ideographic space, U+3000
WHITE_SPACE = "".join(filter(str.isspace, map(chr, range(0x3001))))
_WORD_GAP = r"[ \t\n\x0B\f\r]+"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (Spark's plain ``trim`` only removes blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_commas(line: Column) -> Column:
    """Keep the last comma of a line as field separator; make the others full-width."""
    body = F.regexp_replace(line, r"[\r\n]+\z", "")
    last = F.substring_index(body, ",", -1)
    head = F.left(body, F.length(body) - F.length(last) - 1)
    return F.when(
        F.contains(body, F.lit(",")),
        F.concat(F.replace(head, F.lit(","), F.lit("，")), F.lit(","), last),
    ).otherwise(body)


def truncate_chars(text: Column, limit: int = MAX_INPUT_CHARS) -> Column:
    return F.substring(text, 1, limit)


def extract_completion(output: Column) -> Column:
    """Text behind the last completion marker, up to the end-of-turn marker, stripped."""
    after = F.substring_index(output, COMPLETION_MARKER, -1)
    marked = F.substring_index(after, END_OF_TURN, 1)
    return strip(F.when(F.contains(output, F.lit(COMPLETION_MARKER)), marked).otherwise(output))


def drop_end_marker(text: Column) -> Column:
    return strip(F.replace(text, F.lit(END_OF_MESSAGE), F.lit("")))


def sentence_of(clean: Column) -> Column:
    """If a full stop occurs anywhere, the first line up to its first full stop, and a full stop."""
    line = F.substring_index(clean, "\n", 1)
    sentence = F.concat(F.substring_index(line, ".", 1), F.lit("."))
    return F.when(F.contains(clean, F.lit(".")), sentence).otherwise(clean)


def first_sentence(text: Column) -> Column:
    """Drop end markers and white space around a generated text, and cut it to its first sentence."""
    return sentence_of(drop_end_marker(text))


def join_rewrite(text: Column, rewrite: Column) -> Column:
    """``text + ' ' + rewrite``; null when either is null, so that ``dropna`` removes the row."""
    return F.concat(text, F.lit(" "), rewrite)


def replace_user_mask(text: Column) -> Column:
    return F.replace(text, F.lit(USER_MASK), F.lit(USER_MASK_REPLACEMENT))


def int_label(label: Column, strict: bool = True) -> Column:
    """Integer label. Strict mode fails the job on a bad value, otherwise the label is null."""
    return label.cast("int") if strict else label.try_cast("int")


def class_index(name: Column, classes: Sequence[str], strict: bool = True) -> Column:
    """0-based position of a class name. Unknown names fail the job, or give null when not strict."""
    # coalesce: a null name is unknown too
    position = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), name), F.lit(0))
    unknown = (
        F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(name, F.lit("null"))))
        if strict
        else F.lit(None)
    )
    return F.when(position > 0, (position - 1).cast("int")).otherwise(unknown.cast("int"))


def is_odd_label(label: Column) -> Column:
    """True for labels outside the binary classes 0 and 1, which callers usually want reported."""
    return ~label.isin(0, 1)


def split_words(text: Column, limit: int = -1) -> Column:
    """Default tokenizer: white-space separated words; ``limit`` stops splitting after so many pieces."""
    return F.split(strip(text), _WORD_GAP, limit)


def truncate_tokens(
    text: Column,
    limit: int,
    keep: str = "first",
    tokenizer: Callable[[Column], Column] | None = None,
    joiner: str = " ",
) -> Column:
    """Keep the first or last ``limit`` tokens. ``tokenizer`` maps text to an array of strings."""
    if keep == "first":
        # the rest of a long text stays one piece, which is cut off
        tokens = tokenizer(text) if tokenizer else split_words(text, limit + 1)
        kept = F.slice(tokens, 1, limit)
    elif keep == "last":
        tokens = (tokenizer or split_words)(text)
        start = F.greatest(F.size(tokens) - limit, F.lit(0)) + 1
        kept = F.slice(tokens, start, limit)
    else:
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    return F.array_join(kept, joiner)
