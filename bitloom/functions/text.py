"""Chunking, tokens and markup as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import let

CHUNK_CHARS, CHUNK_TOKENS = 2048, 512
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+|\s+"
PROMPT = "Represent this sentence for searching relevant passages: "
PALETTE = tuple(f"\x1b[{n}m" for n in range(41, 48))
#: Named entities that `html_text` decodes besides numeric ones; &amp; is last, so that what it yields isn't decoded again.
ENTITIES = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&trade;", "™"), ("&reg;", "®"), ("&deg;", "°"), ("&plusmn;", "±"), ("&times;", "×"), ("&euro;", "€"), ("&pound;", "£"), ("&sect;", "§"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&eacute;", "é"), ("&egrave;", "è"), ("&ecirc;", "ê"), ("&agrave;", "à"), ("&acirc;", "â"), ("&ccedil;", "ç"), ("&ntilde;", "ñ"), ("&amp;", "&"))


class Tokenizer(Protocol):
    """Token counts and chunks of a text as columns. `tokens`, `token_count` and `token_chunks` are the native default."""

    def count(self, text: Column) -> Column: ...

    def chunks(self, text: Column, size: int = CHUNK_TOKENS) -> Column: ...


class LoadedTokenizer:
    """A vocabulary's tokenizer, loaded once in each worker, as Arrow-batched functions. load: gives (encode: str to ids, decode: ids to str). special: marks that a model adds to a text."""

    def __init__(self, load: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]], special: int = 0):
        self.load, self.special = load, special

    def count(self, text: Column) -> Column:
        """Number of ids and of special marks; null counts as empty."""
        load, special = self.load, self.special

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode, _ = load()
            for texts in batches:
                yield texts.map(lambda t: len(encode(t or "")) + special).astype("int64")

        return F.pandas_udf(run, "bigint")(text)

    def chunks(self, text: Column, size: int = CHUNK_TOKENS) -> Column:
        """Windows of `size` ids, decoded; a text of up to `size` ids stays as it is, so an empty text is one empty chunk."""
        load = self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode, decode = load()

            def cut(t: str) -> list[str]:
                ids = encode(t or "")
                return [t or ""] if len(ids) <= size else [decode(ids[i : i + size]) for i in range(0, len(ids), size)]

            for texts in batches:
                yield texts.map(cut)

        return F.pandas_udf(run, "array<string>")(text)


def tiktoken_file(path: str, pattern: str) -> LoadedTokenizer:
    """A tokenizer from a file of ranks; strings of special tokens are ordinary text."""

    def load() -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return own.encode_ordinary, own.decode

    return LoadedTokenizer(load)


def random_text(spark, tokens_: int, rows: int = 1, seed: int = 7, words: tuple[str, ...] = ("river", "stone", "light", "paper", "cloud", "glass", "north", "seven")) -> DataFrame:
    """(id, text): random words with a space between them, so that `token_count` of each text is `tokens_`; a last space makes an even number right."""
    pick = lambda i: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(words))).cast("int"))
    n = (tokens_ + 1) // 2
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), pick), " ")
    text = F.concat(text, F.lit(" ")) if tokens_ % 2 == 0 else text
    return spark.range(rows).select("id", (text if tokens_ > 0 else F.lit("")).alias("text"))


def char_chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Consecutive pieces of `size` characters; an empty or null text has none."""
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Runs of letters and digits, of signs, and of white space; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_count(text: Column, special: int = 0) -> Column:
    """Tokens, and `special` more for the marks that a model's tokenizer adds."""
    return F.size(tokens(text)) + special


def token_chunks(text: Column, size: int = CHUNK_TOKENS) -> Column:
    """Windows of `size` tokens; up to `size` tokens leave the text as it is, so an empty text is one empty chunk."""
    windows = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(t, i * size + 1, F.lit(size)), ""))
    return let(tokens(text), lambda t: F.when(F.size(t) <= size, F.array(text)).otherwise(windows(t)))  # else each window would cut the whole text into tokens again


def word_chunks(text: Column, size: int = CHUNK_TOKENS) -> Column:
    """Windows of `size` words, lower case, joined by a space."""
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "))
    return let(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.when(F.size(w) <= size, F.array(F.array_join(w, " "))).otherwise(windows(w)))


def list_chunks(texts: Column, cut: Callable[[Column], Column] = char_chunks) -> Column:
    """The chunks of a list of texts, one text after another."""
    return F.flatten(F.transform(texts, cut))


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row a chunk: `keep`, chunk_idx from 0, text."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_idx", "text"))


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; white space runs are one space; known entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return F.when(F.contains(t, F.lit("&")), _entities(t)).otherwise(t)


def _entities(t: Column) -> Column:
    """Numeric entities, then named ones. The text is cut at its numeric entities, whose characters come between the parts."""
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def char(m: Column) -> Column:
        body = F.lower(F.substring(m, F.lit(3), F.length(m) - 3))
        number = F.when(body.startswith("x"), F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).cast("int")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "utf-32")

    parts, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(_named(a), F.when(b.isNull(), "").otherwise(char(b)))), "")
    return F.when(F.contains(t, F.lit("&#")), joined).otherwise(_named(t))


def _named(t: Column) -> Column:
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def colour_tokens(t: Column) -> Column:
    """Token strings with background colours in turn."""
    palette = F.array(*[F.lit(c) for c in PALETTE])
    return F.concat(F.array_join(F.transform(t, lambda x, i: F.concat(F.get(palette, i % len(PALETTE)), x)), ""), F.lit("\x1b[0m"))


def prompted(query: Column, prompt: str = PROMPT) -> Column:
    return F.concat(F.lit(prompt), query)
