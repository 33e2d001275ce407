"""Column functions over text: normalisation, counting, tolerant JSON and judge-answer repair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word characters for counting: Unicode letters, numbers and the underscore.
WORD = r"[\p{L}\p{N}_]+"
#: Spellings of a category that mean the same (fixed values).
CATEGORY_ALIASES = {"Medial-Lateral Orientation": "Medial-Lateral Orientation (Centricity)"}
#: Control strings that generation leaves in a text (fixed values).
CONTROL_TOKENS = ("<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
#: Ordered suffixes of judgment file names (fixed values).
JUDGE_SUFFIXES = ("_gemini2.5_eval_full.json", "_gemini2.5_eval_fixed.json", "_gemini2.5_eval.json", "_gemini_eval.json", "_gpt_eval.json", "_qwen_eval.json")
#: Ordered suffixes of prediction file names (fixed values).
PREDICTION_SUFFIXES = ("_predictions_full.jsonl", "_predictions.jsonl")
#: Ordered literal repairs of a broken JSON list (fixed values).
JSON_REPAIRS = ((",\n]", "\n]"), (", ]", "]"), (",]", "]"), ('"}  {', '"}, {'), ("}\n  {", "},\n  {"))
#: One item of a Python list literal: a quoted string with escapes, a name or a number.
LITERAL = r"""(?:'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|None|True|False|[-+]?\d+(?:\.\d+)?)"""
FENCE = "`" * 3


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda variable is bound, a column would be copied into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: str | Column) -> Column:
    """Words of a text by Unicode word characters; null and empty have none."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({WORD})"), F.lit(0))).cast("long")


def strip(text: str | Column) -> Column:
    """Without any white space at either end (``trim`` removes spaces alone)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def normalize(text: str | Column, lower: bool = False) -> Column:
    """Null becomes empty, surrounding white space goes, optionally lower case."""
    out = strip(F.coalesce(_c(text), F.lit("")))
    return F.lower(out) if lower else out


def first_truthy(*cols: str | Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in cols))


def default_text(text: str | Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(_c(text), F.lit("")), F.lit(fallback))


def strip_code_fence(text: str | Column, *languages: str) -> Column:
    """A fenced block's body: backticks and newlines at both ends go, then a leading language line (default json; several in
    turn); other text is stripped."""

    def unfenced(t: Column) -> Column:
        body = F.regexp_replace(t, "^[`\n]+|[`\n]+$", "")
        for language in languages or ("json",):
            body = F.regexp_replace(F.regexp_replace(body, rf"^{language}\s*\n", ""), rf"^{language}(?=[\[{{])", "")
        return F.when(t.startswith(FENCE), strip(body)).otherwise(t)

    return let(strip(text), unfenced)


def sanitize_json(text: str | Column) -> Column:
    """Ordered literal repairs: commas before a closing bracket go, missing commas between objects come in."""
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), JSON_REPAIRS, _c(text))


def _last(text: Column, mark: str) -> Column:
    """1-based place of the last ``mark``; 0 if there is none."""
    at = F.instr(F.reverse(text), mark)
    return F.when(at == 0, F.lit(0)).otherwise(F.length(text) - at + 1)


def extract_list(text: str | Column) -> Column:
    """From the first ``[`` to the last ``]``; null unless the latter comes after the former."""
    t = _c(text)
    a, b = F.instr(t, "["), _last(t, "]")
    return F.when((a > 0) & (b > a), F.substring(t, a, b - a + 1))


def repair_list(text: str | Column) -> Column:
    """A truncated list: from the first ``[`` to the last ``}``, a trailing comma off, closed with ``]``; null if neither is there."""
    t = _c(text)
    a, b = F.instr(t, "["), _last(t, "}")
    body = F.regexp_replace(F.substring(t, a, b - a + 1), r"[\s,]+$", "")
    return F.when((a > 0) & (b > a), F.concat(body, F.lit("]")))


def parse_list(text: str | Column, element: T.DataType, lenient: bool = True) -> Column:
    """Tolerant parse of a JSON list: as it is, its bracketed part, that part with newlines escaped, and last (lenient) the repaired one."""
    kind = T.ArrayType(element)

    def tried(t: Column) -> Column:
        parts = let(extract_list(t), lambda x: F.coalesce(*(F.from_json(y, kind) for y in (x, F.replace(x, F.lit("\n"), F.lit("\\n")), sanitize_json(x)))))
        return F.coalesce(F.from_json(t, kind), parts, *([F.from_json(repair_list(t), kind)] if lenient else []))

    return let(strip_code_fence(text), tried)


def _json_items(t: Column) -> Column:
    """The items of a text that is one strict JSON list, as Python would write them, without false ones; null if it is no JSON.

    Boxed, so that a text with a tail is no JSON and one with a second value has two items.  Any other JSON value has no items.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    # the reader of variants forgives nothing but what stands behind a value: the box takes that away
    one = F.size(F.try_variant_get(boxed, "$", "array<variant>")) == 1

    def item(x: Column) -> Column:
        kind, s = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        empty = (kind == "VOID") | s.isNull() | (s == "") | s.isin("[]", "{}") & kind.rlike("^(ARRAY|OBJECT)") | number & (F.try_variant_get(x, "$", "double") == 0) | (kind == "BOOLEAN") & (s == "false")
        return F.when(empty, F.lit(None)).when(kind == "BOOLEAN", F.lit("True")).otherwise(s)

    items = F.try_variant_get(boxed, "$[0]", "array<variant>")
    return F.when(one, F.coalesce(F.filter(F.transform(items, item), lambda x: x.isNotNull()), F.array().cast("array<string>")))


def parse_categories(text: str | Column) -> Column:
    """A list of labels from a strict JSON list, else from a Python list literal, else from quoted strings between brackets.

    Of the first two false items (empty, 0, false, None) go, other items become text as Python writes it.  Of the last,
    double-quoted strings come before single-quoted ones, and blank ones go.  Labels are stripped; a text that is another
    JSON value, or has something behind the list, has none.
    """

    def item(x: Column) -> Column:
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        for escape, char in (("\\n", "\n"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
            body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\" + escape[1], "$1" + char)
        body = F.nullif(F.replace(body, F.lit("\\\\"), F.lit("\\")), F.lit(""))
        return F.when(x.rlike("^['\"]"), body).when(x.rlike(r"^(None|False|[-+]?0+(\.0+)?)$"), F.lit(None)).otherwise(x)

    def parsed(t: Column) -> Column:
        literal = F.when(t.rlike(rf"^\[\s*(?:{LITERAL}\s*(?:,\s*{LITERAL}\s*)*+(?:,\s*)?)?\]$"), F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"({LITERAL})"), F.lit(1)), item), lambda x: x.isNotNull()))
        boxed = t.rlike(r"(?s)^\[.*\]$")
        double = F.regexp_extract_all(t, F.lit('"([^"]*)"'), F.lit(1))
        single = F.regexp_extract_all(t, F.lit("'([^']*)'"), F.lit(1))
        full = lambda a: F.filter(a, lambda x: strip(x) != "")
        quoted = F.when(boxed & (F.size(double) > 0), full(double)).when(boxed & (F.size(single) > 0), full(single))
        got = F.coalesce(F.when(t != "", _json_items(t)), literal, quoted, F.array().cast("array<string>"))
        return F.transform(got, strip)

    return let(strip_code_fence(text, "python", "json"), parsed)


def canonical_categories(labels: str | Column) -> Column:
    """Stripped labels without blanks, aliases replaced; repeated labels stay repeated."""
    def fix(x: Column) -> Column:
        s = strip(x)
        return reduce(lambda c, kv: F.when(s == kv[0], F.lit(kv[1])).otherwise(c), CATEGORY_ALIASES.items(), s)

    return F.filter(F.transform(F.coalesce(_c(labels), F.array().cast("array<string>")), fix), lambda x: x.isNotNull() & (x != ""))


def recover_verdict(verdict: str | Column, reasoning: str | Column) -> Column:
    """A null verdict read from the judge's reasoning, if that holds one as JSON; else still null."""
    found = F.regexp_extract(F.coalesce(_c(reasoning), F.lit("")), r'"is_correct"\s*:\s*(true|false)', 1)
    return F.coalesce(_c(verdict), F.when(found != "", found == "true"))


def strip_control_tokens(text: str | Column) -> Column:
    return strip(reduce(lambda c, k: F.replace(c, F.lit(k), F.lit("")), CONTROL_TOKENS, _c(text)))


def drop_prompt_echo(text: str | Column, prompt: str | Column) -> Column:
    """Cut the prompt where the text repeats it within its first three characters."""
    t, p = _c(text), _c(prompt)
    at = F.call_function("locate", p, t)
    return F.when((F.length(p) > 0) & (at >= 1) & (at <= 3), strip(F.substring(t, at + F.length(p), F.length(t)))).otherwise(t)


def response_text(text: str | Column, parts: str | Column) -> Column:
    """A response's text, else its candidate parts joined by newlines."""
    return F.coalesce(F.nullif(_c(text), F.lit("")), F.array_join(F.filter(_c(parts), lambda x: x.isNotNull()), "\n"))


def model_of_file(name: str | Column) -> Column:
    """File name without the first judge or prediction suffix that fits, else its stem."""
    file = F.element_at(F.split(_c(name), "/"), -1)
    out = F.regexp_replace(file, r"\.(jsonl|json|csv)$", "")
    for s in reversed((*JUDGE_SUFFIXES, *PREDICTION_SUFFIXES)):
        out = F.when(file.endswith(s), F.substring(file, F.lit(1), F.length(file) - len(s))).otherwise(out)
    return out


def display_label(name: str | Column, labels: dict[str, str]) -> Column:
    """A display label from a small map, else the name itself."""
    if not labels:
        return _c(name)
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(table, _c(name)), _c(name))


def floor2(x: Column) -> Column:
    """Down to two decimals."""
    return F.floor(x * F.lit(100.0)).cast("double") / F.lit(100.0)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, or ``empty`` where the denominator is 0."""
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(num.cast("double") / den)


def numbered_prompt(items: str | Column, template: str = "{i}. {x}") -> Column:
    """A numbered block of lines from an array of strings (1-based)."""
    before, after = template.split("{x}")[0].split("{i}"), template.split("{x}")[1]
    return F.array_join(F.transform(_c(items), lambda x, i: F.concat(F.lit(before[0]), (i + 1).cast("string"), F.lit(before[1]), F.coalesce(x, F.lit("")), F.lit(after))), "\n")


def data_uri(image: str | Column, mime: str = "image/jpeg") -> Column:
    """The bytes as a data URI; ``base64`` breaks its lines after 76 characters, which an URI must not."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(_c(image)), "\r\n", ""))


def chat_messages(question: str | Column, uris: str | Column, system: str | None = None) -> Column:
    """Messages of a slice-wise visual prompt: an optional system text, then each slice image with its label, then the question."""
    entry = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    slices = F.flatten(F.transform(_c(uris), lambda u, i: F.array(entry("image", u), entry("text", F.concat(F.lit("SLICE "), (i + 1).cast("string"))))))
    head = [F.array(entry("system", F.lit(system)))] if system else []
    return F.concat(*head, slices, F.array(entry("text", _c(question))))
