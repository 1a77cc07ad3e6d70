"""Text functions: Column in, Column out, all built-in expressions.

`words` splits on Unicode white space, as all functions here that speak of words do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of words with a meaning, and the placeholders they become.
URL_WORD = r"^[(\[<]*(https?://|www\.|tenor\.com/|discord\.gg/|discord\.com/|cdn\.discordapp\.com/|youtube\.com/|youtu\.be/)"
EMOJI_WORD = r"^:[A-Za-z0-9_]{2,32}:\z"
MENTION_WORD = r"^\((@&?[0-9]+|#[0-9]+|t:[0-9]+:R|id:browse)\)\z"
ROLE_PING = r"^@(everyone|here|[0-9]+)\z"
ALPHANUMERIC = r"[\p{IsAlphabetic}\p{N}]"
URL, MENTION, EMOJI = "__URL__", "__MENTION__", "__EMOJI__"
PAD, UNK, SEC = "<PAD>", "<UNK>", "<SEC>"
LEGACY_TAGS = ["</BOT>", "<USER>", "</USER>", "<BOT>"]
REFUSALS = [
    r"\bas an ai (language )?model\b",
    r"\bi (?:am|'m) (?:an? )?(?:large )?language model\b",
    r"\bi (?:can(?:not| ?'t)) (?:provide|help|assist|do)\b",
    r"\bi don'?t have (?:personal )?opinions\b",
]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def one_spaced(text: Column) -> Column:
    """The words with one space between them; of ASCII texts the plain expression, which is faster, finds the same white space."""
    return F.trim(F.when(_ascii(text), F.regexp_replace(text, r"\s+", " ")).otherwise(F.regexp_replace(text, r"(?U)\s+", " ")))


def is_url(word: Column) -> Column:
    return word.rlike(URL_WORD)


def is_emoji_shortcode(word: Column) -> Column:
    return word.rlike(EMOJI_WORD)


def is_paren_mention(word: Column) -> Column:
    return word.rlike(MENTION_WORD)


def is_role_ping(word: Column) -> Column:
    return word.rlike(ROLE_PING)


def is_role_ping_only(text: Column) -> Column:
    w = words(text)
    return (F.size(w) > 0) & F.forall(w, is_role_ping)


def strip_urls(text: Column) -> Column:
    return F.array_join(F.filter(words(text), lambda w: ~is_url(w)), " ")


def is_url_dominant(text: Column, least: int = 8) -> Column:
    """There is a URL word, and fewer than least other characters."""
    w = words(text)
    rest = F.array_join(F.filter(w, lambda x: ~is_url(x)), "")
    return F.exists(w, is_url) & (F.length(rest) < least)


def has_alphanumeric(text: Column) -> Column:
    return text.rlike(ALPHANUMERIC)


def _replace_words(text: Column, test, new: str) -> tuple[Column, Column]:
    w = words(text)
    return F.array_join(F.transform(w, lambda x: F.when(test(x), F.lit(new)).otherwise(x)), " "), F.size(F.filter(w, test))


def rewrite_urls(text: Column) -> tuple[Column, Column]:
    """(text, number of words replaced); so are the other rewrites."""
    return _replace_words(text, is_url, URL)


def rewrite_mentions(text: Column) -> tuple[Column, Column]:
    return _replace_words(text, is_paren_mention, MENTION)


def rewrite_emoji(text: Column) -> tuple[Column, Column]:
    return _replace_words(text, is_emoji_shortcode, EMOJI)


_PLACEHOLDER = r"(__(?:URL|MENTION|EMOJI)__)(?!\S)"
_STEPS = [
    (r"\*{2,}", " "),
    (r"(?U)" + _PLACEHOLDER + r"|_{2,}", "$1 "),
    (r"-{2,}", "-"),
    (r"(?U)(?<!\S)\*(?!\S)", " "),
]
_LEADING = [r"^(:- |- |: )", r"^[0-9]+\. "]


def strip_markdown(text: Column) -> tuple[Column, Column]:
    """Runs of decoration become a space or one hyphen; one leading bullet and one leading number go."""
    s, count = text, F.lit(0)
    for pattern, new in _STEPS:
        found = F.regexp_count(s, F.lit(pattern))
        if new == "$1 ":
            found = found - F.regexp_count(s, F.lit("(?U)" + _PLACEHOLDER))
        count, s = count + found, F.regexp_replace(s, pattern, new)
    s = one_spaced(s)
    for pattern in _LEADING:
        count, s = count + F.regexp_count(s, F.lit(pattern)), F.regexp_replace(s, pattern, "")
    return one_spaced(s), count


_ESCAPES = r"(?s)\\.|\\|[^\\]+"


def strip_escapes(text: Column) -> tuple[Column, Column]:
    """Backslash escapes in one pass from the left: \\n, \\r, \\t are spaces, \\\\ goes, \\x is x."""
    parts = F.regexp_extract_all(text, F.lit(_ESCAPES), F.lit(0))
    escaped = lambda p: p.startswith("\\")
    plain = F.transform(
        parts,
        lambda p: F.when(~escaped(p), p).when(p.isin("\\n", "\\r", "\\t"), F.lit(" ")).when(p.isin("\\\\", "\\"), F.lit("")).otherwise(F.substring(p, 2, 1)),
    )
    count = F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(p == "\\\\", 2).when(escaped(p), 1).otherwise(0))
    return one_spaced(F.array_join(plain, "")), count


def unescape_tsv(text: Column) -> Column:
    """\\n, \\t, \\r and \\\\ in one pass; other escapes keep their backslash."""
    parts = F.regexp_extract_all(text, F.lit(_ESCAPES), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "\\n", "\n").when(p == "\\t", "\t").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)), "")


def sanitize_tags(text: Column) -> Column:
    """Angle brackets become round ones and control characters spaces; spacing is kept."""
    return F.translate(text, "<>\n\r\t", "()   ")


def sanitize(text: Column) -> Column:
    return one_spaced(sanitize_tags(text))


def sanitize_chat(text: Column) -> Column:
    """As sanitize, with URL words and emoji shortcodes as placeholders."""
    w = words(sanitize_tags(text))
    return F.array_join(F.transform(w, lambda x: F.when(is_url(x), F.lit(URL)).when(is_emoji_shortcode(x), F.lit(EMOJI)).otherwise(x)), " ")


def sanitize_prompt(text: Column, most: int = 240) -> Column:
    s = one_spaced(text)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def sanitize_tree(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "<>", "()"), r"(?U)\s+", " "))


def truncate_at_sentence(text: Column, cap: int = 400) -> Column:
    """At most cap characters; cut after the last '. ' (else '! ', else '? ') of the last quarter if there is one."""
    floor = cap * 3 // 4
    late = F.substring(text, floor + 1, cap - floor)
    cut = F.lit(cap)
    for mark in ("? ", "! ", ". "):
        back = F.locate(mark[::-1], F.reverse(late))
        cut = F.when(back > 0, floor + F.length(late) - back).otherwise(cut)
    return F.when(F.length(text) > cap, F.regexp_replace(F.substring(text, F.lit(1), cut), r"(?U)\s+\z", "")).otherwise(text)


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, "\n\r\t", "   "), F.lit(r"(?s).+?(?:[.!?](?=\s|$)|$)"), F.lit(0))
    return F.filter(F.transform(found, one_spaced_trim), lambda s: s != "")


def one_spaced_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def keep_tree_text(text: Column, role: Column) -> Column:
    """At least ten characters, no code fence, and no refusal by the assistant."""
    refused = F.lit(False)
    for p in REFUSALS:
        refused = refused | text.rlike("(?iu)" + p)
    return (F.length(text) >= 10) & ~F.contains(text, F.lit("```")) & ~((role == "assistant") & refused)


def is_special(chunk: Column) -> Column:
    n = F.regexp_extract(chunk, r"^</?PERSON_\+?([0-9]{1,18})>\z", 1)
    tag = F.coalesce(F.when(n != "", n.cast("long")) <= 4294967295, F.lit(False))
    return chunk.isin(PAD, UNK, SEC, URL, MENTION, EMOJI, *LEGACY_TAGS) | tag


TOKEN = r"(?U)[\p{IsAlphabetic}\p{N}']+|[^\p{IsAlphabetic}\p{N}'\s]"
#: The same for ASCII in lower case.
ASCII_TOKEN = r"[a-z0-9']+|[^a-z0-9'\s]"


def tokenize(text: Column) -> Column:
    """Special chunks as they are; of others, lower-cased, each run of letters, digits and ' and each other character.

    Letters are lower-cased one by one, so a capital sigma that ends a word is no final sigma.
    Tokens never hold white space, so a text without < and __, with which special chunks begin, is cut as a whole.
    """
    lower = lambda w: F.lower(F.translate(w, "Σ", "σ"))
    plain = F.when(_ascii(text), F.regexp_extract_all(F.lower(text), F.lit(ASCII_TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(lower(text), F.lit(TOKEN), F.lit(0)))
    return F.when(~F.contains(text, F.lit("<")) & ~F.contains(text, F.lit("__")), plain).otherwise(_word_by_word(text, lower))


def _word_by_word(text: Column, lower) -> Column:
    return F.flatten(F.transform(words(text), lambda w: F.when(is_special(w), F.array(w)).otherwise(F.regexp_extract_all(lower(w), F.lit(TOKEN), F.lit(0)))))


def detokenize(tokens: Column) -> Column:
    """Tokens joined by spaces; those without letter, digit or ' stick to what is before."""
    glued = F.transform(tokens, lambda t: F.when(t.rlike(r"[\p{IsAlphabetic}\p{N}']"), F.concat(F.lit(" "), t)).otherwise(t))
    return F.regexp_replace(F.array_join(glued, ""), "^ ", "")


def open_tag(person: Column) -> Column:
    return F.concat(F.lit("<PERSON_"), person.cast("string"), F.lit(">"))


def close_tag(person: Column) -> Column:
    return F.concat(F.lit("</PERSON_"), person.cast("string"), F.lit(">"))


def tag_person(tag: Column, closing: bool = False) -> Column:
    """The person of an opening (or closing) tag, null for anything else."""
    n = F.regexp_extract(tag, rf"^<{'/' if closing else ''}PERSON_\+?([0-9]{{1,18}})>\z", 1)
    number = F.when(n != "", n.cast("long"))
    return F.when(number <= 4294967295, number)


def wrap(person: Column, tokens: Column) -> Column:
    return F.concat(F.array(open_tag(person)), tokens, F.array(close_tag(person)))


def dedup_key(text: Column) -> Column:
    return F.lower(one_spaced_trim(text))


def prefix_key(text: Column, n: int = 3) -> Column:
    """The first n words in lower case; null for fewer."""
    w = words(text)
    return F.when(F.size(w) >= n, F.lower(F.array_join(F.slice(w, 1, n), " ")))


def index_array(text: Column) -> Column:
    """The first [...] as whole numbers of at least 0; empty if it isn't that."""
    found = F.from_json(F.regexp_extract(text, r"\[[^\]]*\]", 0), "array<bigint>")
    empty = F.array().cast("array<bigint>")
    return F.when(found.isNotNull() & F.forall(found, lambda x: x.isNotNull() & (x >= 0)), found).otherwise(empty)


def json_field(body: Column, key: str) -> Column:
    """The string after the first "key" of a body that need not be whole JSON; null if none follows, or one with a broken escape.

    Escapes are those of JSON without halves of surrogate pairs.
    """
    rest = F.substr(body, F.nullif(F.instr(body, f'"{key}"'), F.lit(0)))
    head = F.regexp_extract(rest, r'^"[^"]*"\s*:\s*"', 0)
    # cut piece by piece, so that strings of any length need no deep match
    pieces = F.regexp_extract_all(F.substr(rest, F.nullif(F.length(head), F.lit(0)) + 1), F.lit(r'(?s)\\u(?:[0-9a-fA-F]{4}|\+[0-9a-fA-F]{3})|\\.|\\|"|[^"\\]+'), F.lit(0))
    end = F.array_position(pieces, '"')

    def read(p: Column) -> Column:
        point = F.translate(F.substring(p, 3, 4), "+", "0")
        coded = F.when(~point.rlike("^[dD][89abAB]") & ~point.rlike("^[dD][c-fC-F]"), F.decode(F.unhex(point), "UTF-16BE"))
        plain = F.when(p.isin('\\"', "\\\\", "\\/"), F.substring(p, 2, 1)).when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t")
        return F.when(~p.startswith("\\"), p).when(p.startswith("\\u") & (F.length(p) == 6), coded).otherwise(plain)

    said = F.transform(F.slice(pieces, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")), read)
    return F.when((end > 0) & ~F.exists(said, lambda p: p.isNull()), F.array_join(said, ""))


def string_similarity(a: Column, b: Column) -> Column:
    """100 if equal; else the excess bytes of a (mod 256) plus equal characters by place, at most 255."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))))
    longer = F.greatest(F.octet_length(a) - F.octet_length(b), F.lit(0))
    return F.when(a == b, 100).otherwise(F.least(F.lit(255), F.pmod(longer, F.lit(256)) + same)).cast("int")


def parse_seconds(ts: Column) -> Column:
    """Unix seconds of yyyy-MM-ddTHH:mm:ss...; fraction and zone are ignored; null if it isn't that."""
    at = F.try_to_timestamp(F.regexp_replace(F.substring(ts, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.length(ts) >= 20, F.unix_timestamp(at))


def snowflake_seconds(id_: Column) -> Column:
    """The time in a snowflake id; its epoch starts 1420070400000 ms after 1970."""
    return F.floor((F.shiftright(id_.cast("long"), 22) + 1420070400000) / 1000).cast("long")
