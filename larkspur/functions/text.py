"""Text functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's str.strip() takes it, for Java's regex.
WHITE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Tags that the simulated user's replies may hold.
KNOWN_TAGS = ("think", "user_state", "message", "report", "state")
END_TAG = "<|End Conversation|>"
CONTINUE_TAG = "<|Continue Conversation|>"
STATE_HEADER = r"#\s*User State Report"
LEAST_STATE = 80  # characters that a state without tags must exceed

# Words that tell what an opening message is after.
RECOMMEND = ("recommend", "suggest", "best", "should i")
SOLVE = ("how to", "how do", "fix", "solve", "help me")
VENT = ("feel", "stressed", "worried", "frustrated", "upset")


def strip(x: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(x, rf"\A{WHITE}+|{WHITE}+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"{WHITE}+\z", "")


def or_default(x: Column, *others: Column | str) -> Column:
    """The first value that is neither null nor empty; the last one stands as it is."""
    lit = [F.lit(o) if isinstance(o, str) else o for o in others]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in [x, *lit[:-1]]], lit[-1])


def safe_id(x: Column) -> Column:
    """Slashes of either kind become underscores."""
    return F.translate(x, "/\\", "__")


def strip_tags(x: Column, tags: tuple[str, ...] = KNOWN_TAGS) -> Column:
    """Without opening and closing tags of the known names; other tags stay."""
    return strip(F.regexp_replace(x, f"</?(?:{'|'.join(tags)})>", ""))


def strip_think(x: Column) -> Column:
    """Without thinking blocks and single closing tags that are left of them."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""), r"</think>", ""))


def end_signal(x: Column, end: str = END_TAG, go_on: str = CONTINUE_TAG) -> Column:
    """struct(message, wants_to_end): a leading tag, or a first line that is just a tag."""
    text = strip(x)
    line = strip(F.substring_index(text, "\n", 1))
    rest = F.when(F.instr(text, "\n") > 0, strip(F.substr(text, F.instr(text, "\n") + 1))).otherwise("")
    after = lambda tag: strip(F.substr(text, F.lit(len(tag) + 1)))
    message = F.when(text.startswith(end), after(end)).when(text.startswith(go_on), after(go_on)).when(line.isin(end, go_on), rest).otherwise(text)
    return F.struct(message.alias("message"), (text.startswith(end) | (line == end)).alias("wants_to_end"))


def between_tags(x: Column, tag: str) -> Column:
    """Text of the first closed pair of a tag; empty where there is none."""
    return strip(F.regexp_extract(x, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def user_turn(x: Column) -> Column:
    """struct(think, user_state, message, wants_to_end) of a simulated user's reply.

    The state is a closed pair, else what follows an opening tag up to the message, else a
    long enough text from the report's header on. The message is a closed pair, else what
    follows an opening tag, else what follows the last closed state.
    """
    raw = F.coalesce(x, F.lit(""))
    stop = r"(?=</?message>|\z)"
    open_state = F.nullif(strip(F.regexp_extract(raw, rf"(?s)<user_state>(.*?){stop}", 1)), F.lit(""))
    header = strip(F.regexp_extract(raw, rf"(?s)({STATE_HEADER}.*?){stop}", 1))
    header = F.when(F.length(header) > LEAST_STATE, header)
    state = F.when(F.rlike(raw, F.lit("(?s)<user_state>.*?</user_state>")), between_tags(raw, "user_state")).otherwise(F.coalesce(open_state, header, F.lit("")))
    open_message = F.nullif(strip(F.regexp_extract(raw, r"(?s)<message>(.*)\z", 1)), F.lit(""))
    after_state = F.when(F.contains(raw, F.lit("</user_state>")), strip(F.substring_index(raw, "</user_state>", -1)))
    message = F.when(F.rlike(raw, F.lit("(?s)<message>.*?</message>")), between_tags(raw, "message")).otherwise(F.coalesce(open_message, after_state, F.lit("")))
    signal = end_signal(strip_tags(message))
    return F.struct(between_tags(raw, "think").alias("think"), state.alias("user_state"), signal["message"].alias("message"), signal["wants_to_end"].alias("wants_to_end"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def intent(prompt: Column) -> Column:
    """One of five intents, from key words and a question mark."""
    p = F.lower(prompt)
    asks = F.contains(p, F.lit("?"))
    return F.when(asks & _any(p, RECOMMEND), "get_recommendation").when(asks & _any(p, SOLVE), "solve_problem").when(asks, "seek_info").when(_any(p, VENT), "vent").otherwise("explore_topic")


def render(template: str | Column, values: dict[str, Column | str]) -> Column:
    """Each {name} replaced in turn, so a value may hold a later placeholder; unknown
    placeholders stay."""
    out = F.lit(template) if isinstance(template, str) else template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v if isinstance(v, Column) else F.lit(v))
    return out


def json_object(x: Column) -> Column:
    """A JSON object as VARIANT: the whole text, else a fenced block, else from the first
    brace to the last; null where none parses. A fence that does not parse ends the search."""
    text = strip(x)
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.when(fence != "", F.try_parse_json(fence)).otherwise(F.try_parse_json(F.nullif(braces, F.lit("")))))


def json_plain(x: Column) -> Column:
    """The shorter ladder of plain JSON calls: whole text, else first brace to last."""
    text = strip(x)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def seed(persona: Column, scenario: Column, style: Column | str) -> Column:
    """Unsigned 64-bit seed of a key, as DECIMAL(20, 0): the first 16 digits of its SHA-256."""
    style = F.lit(style) if isinstance(style, str) else style
    digest = F.sha2(F.concat_ws("|", persona, scenario, style).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def choice(x: Column) -> Column:
    """The first of A to D inside the first <choice> element without inner tags, else null."""
    body = F.regexp_extract(x, r"(?is)<choice[^>]*>([^<]*)", 1)
    return F.nullif(F.regexp_extract(body, "[ABCD]", 0), F.lit(""))


def element(x: Column, tag: str) -> Column:
    """Text of an element, inner tags left out; an element that is not closed runs on."""
    body = F.regexp_extract(x, rf"(?is)<{tag}[^>]*>(.*?)(?:</{tag}>|\z)", 1)
    return strip(F.regexp_replace(body, "<[^>]*>", ""))


def acknowledges(preference: Column, response: Column, quote: Column) -> Column:
    """Whether a response takes up a preference: it holds the quote, or two of the distinct
    tokens of four characters and more (before their punctuation goes)."""
    words = F.filter(F.split(strip(preference), rf"{WHITE}+"), lambda t: F.length(t) >= 4)
    tokens = F.array_distinct(F.transform(words, lambda t: F.btrim(F.lower(t), F.lit(".,!?;:\"'"))))
    # The response is lowered once: as an array's item it has a name inside the function.
    hits = F.get(F.transform(F.array(F.lower(response)), lambda low: F.size(F.filter(tokens, lambda t: (t != "") & F.contains(low, t)))), F.lit(0))
    quoted = (F.coalesce(quote, F.lit("")) != "") & F.contains(F.lower(response), F.lower(quote))
    given = (F.coalesce(preference, F.lit("")) != "") & (F.coalesce(response, F.lit("")) != "")
    return F.coalesce(given & (quoted | (hits >= 2)), F.lit(False))


def answer_score(predicted: Column, true_answer: Column, answer_key: Column) -> Column:
    """The right key anywhere wins; else the other key loses; else the answer's first 20
    characters count."""
    p = F.lower(predicted)
    other = F.when(answer_key == "a)", F.lit("b)")).otherwise(F.lit("a)"))
    return F.when(F.contains(p, answer_key), True).when(F.contains(p, other), False).otherwise(F.contains(p, F.substring(F.lower(true_answer), 1, 20)))


def n_tokens(x: Column) -> Column:
    """Stand-in token count: runs of characters that are not white space."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\S+)"), F.lit(1)))


def indented_json(x: Column) -> Column:
    """A JSON text with a field on each line, as people read it; null where it does not parse or
    holds nothing. For the few rows of a table of personas."""

    @F.pandas_udf("string")
    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False) if t else None)

    value = F.try_parse_json(x)
    kept = F.when(~F.to_json(value).isin("{}", "[]", "null", '""'), x)
    return indented(F.when(value.isNotNull(), kept))
