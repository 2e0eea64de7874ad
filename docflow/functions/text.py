"""Text columns: tokens, trimming, fences, masking. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white-space class of the `words` encoding and its token pattern.
# Concatenating all matches of the pattern restores the text.
SPACE = r"[ \t\n\r\f]"
TOKEN = r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+\z"

# Every character a script engine's trim() strips.
TRIM_CHARS = "\t\n\x0b\f\r " + "".join(map(chr, (
    0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def trim_all(col: Column) -> Column:
    """Strip all Unicode white space at both ends (``F.trim`` strips blanks only)."""
    return F.btrim(col, F.lit(TRIM_CHARS))


def trim_end(col: Column) -> Column:
    return F.rtrim(col, F.lit(TRIM_CHARS))


def _word_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def _word_count(col: Column) -> Column:
    # Pieces between white-space runs, less the empty piece before leading space.
    # The empty piece after trailing space stands for the trailing token.
    leading = F.substring(col, 1, 1).isin(" ", "\t", "\n", "\r", "\f").cast("int")
    return F.when(col == "", F.lit(0)).otherwise(F.size(F.split(col, SPACE + "+")) - leading)


class Encoding:
    """A named token encoding: ``count`` and ``tokens`` map a text column to a column."""

    def __init__(self, name: str, count: Callable[[Column], Column],
                 tokens: Callable[[Column], Column]):
        self.name, self.count, self.tokens = name, count, tokens


_ENCODINGS: dict[str, Encoding] = {"words": Encoding("words", _word_count, _word_tokens)}


def register_encoding(name: str, count: Callable[[Column], Column],
                      tokens: Callable[[Column], Column]) -> None:
    """Add an encoding. ``array_join(tokens(text), '')`` must give back the text."""
    _ENCODINGS[name] = Encoding(name, count, tokens)


def register_bpe(name: str, load: Callable[[], object]) -> None:
    """Register a byte-pair encoding through Arrow batches.

    ``load`` returns an object with ``encode(str) -> list[int]`` and
    ``decode_single_token_bytes(int) -> bytes``; it runs once per Python worker. Where a cut between two tokens
    falls inside a character, both sides read U+FFFD there, as a decoder of token ids gives it.
    """
    cache: dict[str, object] = {}

    def encoder():
        if "e" not in cache:
            cache["e"] = load()
        return cache["e"]

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder()
        return texts.map(lambda t: None if t is None else len(enc.encode(t)))

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        enc = encoder()

        def one(text):
            if text is None:
                return None
            # latin-1 keeps every byte of a partial character; decoded after slicing.
            return [enc.decode_single_token_bytes(t).decode("latin-1") for t in enc.encode(text)]
        return texts.map(one)

    @F.pandas_udf("array<string>")
    def slices(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        enc, pieces = encoder(), {}

        def piece(token: int) -> bytes:
            if token not in pieces:
                pieces[token] = enc.decode_single_token_bytes(token)
            return pieces[token]

        def one(text, los, his):
            if text is None:
                return None
            found = list(map(piece, enc.encode(text)))
            return [b"".join(found[lo:hi]).decode("latin-1") for lo, hi in zip(los.tolist(), his.tolist())]
        return pd.Series([one(*row) for row in zip(texts, starts, ends)], dtype=object)

    register_encoding(name, lambda c: count(c), lambda c: tokens(c))
    # The texts of slices are put together in Python, so that no token is a value of its own on the way to the JVM.
    _ENCODINGS[name].slices = lambda c, ranges: slices(c, F.transform(ranges, lambda r: r["lo"]), F.transform(ranges, lambda r: r["hi"]))
    _ENCODINGS[name].join = lambda parts: F.make_valid_utf8(F.encode(F.array_join(parts, ""), "ISO-8859-1").cast("string"))


def register_tiktoken(name: str, ranks_path: str, pattern: str) -> None:
    """Register a byte-pair encoding from a local file of ranks (a base64 token and its id in each line) and the pattern
    that cuts texts before merging. Special tokens in a text are plain text."""
    def load() -> object:
        import base64

        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(no) for token, no in map(bytes.split, lines)}
        made = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _Ordinary(made)

    register_bpe(name, load)


class _Ordinary:
    def __init__(self, made):
        self.encode, self.decode_single_token_bytes = made.encode_ordinary, made.decode_single_token_bytes


def encoding(name: str) -> Encoding:
    if name not in _ENCODINGS:
        raise ValueError(f"unknown encoding {name!r}; registered: {sorted(_ENCODINGS)}")
    return _ENCODINGS[name]


def token_count(col: Column, name: str = "words") -> Column:
    return encoding(name).count(col)


def tokens(col: Column, name: str = "words") -> Column:
    return encoding(name).tokens(col)


def token_slices(col: Column, ranges: Column, name: str = "words") -> Column:
    """The texts of the tokens ``lo`` to ``hi`` (exclusive) of a text, for each of ``ranges(lo, hi)``; NULL stays NULL."""
    enc = encoding(name)
    if hasattr(enc, "slices"):
        return F.transform(enc.slices(col, ranges), lambda t: join_tokens(F.array(t), name))
    # The one-element array binds the token list once for all ranges.
    return F.transform(F.array(tokens(col, name)), lambda toks: F.transform(ranges, lambda r: join_tokens(
        F.slice(toks, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), name)))[0]


def join_tokens(parts: Column, name: str = "words") -> Column:
    enc = encoding(name)
    return enc.join(parts) if hasattr(enc, "join") else F.array_join(parts, "")


def strip_code_fence(col: Column) -> Column:
    """Remove a leading ```lang line start and a trailing ``` fence, then trim."""
    opened = F.regexp_replace(trim_all(col), r"^```[a-zA-Z]*\s*", "")
    return trim_all(F.regexp_replace(opened, r"```\z", ""))


def strip_json_fence(col: Column) -> Column:
    """Unwrap text that is wholly one ```json … ``` block; else only trim."""
    return trim_all(F.regexp_replace(col, r"(?is)^```(?:json)?\s*(.+?)\s*```\z", "$1"))


def mask_data_url(col: Column) -> Column:
    return F.when(col.startswith("data:image"),
                  F.concat(F.lit("[DATA_URL length="), F.length(col).cast("string"), F.lit("]"))
                  ).otherwise(col)


def truncate(col: Column, limit: int = 200) -> Column:
    return F.when(F.length(col) > limit,
                  F.concat(F.substring(col, 1, limit), F.lit("...[truncated]"))).otherwise(col)


def redact(df: DataFrame, limit: int = 200) -> DataFrame:
    """Mask image data URLs and shorten long text in every string column, for logs."""
    return df.select(*[truncate(mask_data_url(F.col(n)), limit).alias(n) if t == "string" else F.col(n)
                       for n, t in df.dtypes])


def fence_length(col: Column) -> Column:
    """One more than the longest first back-tick run of any line, and at least four."""
    runs = F.transform(F.split(col, "\n"), lambda line: F.length(F.regexp_extract(line, "(`+)", 1)))
    return F.greatest(F.lit(3), F.array_max(runs)) + 1


def fence_attachment(filename: Column, markdown: Column) -> Column:
    """Markdown of a document attachment between fences its text cannot close."""
    bound = F.repeat(F.lit("`"), fence_length(markdown))
    return F.concat(F.lit("\n\n# File attached: "), filename, F.lit("\n"), bound, F.lit("\n"),
                    markdown, F.lit("\n"), bound)


def json_string(col: Column) -> Column:
    """A text column as a quoted JSON string; NULL stays NULL."""
    # A one-element array without its brackets.
    return F.when(col.isNotNull(), F.regexp_replace(F.to_json(F.array(col)), r"^\[|\]\z", ""))
