"""Text functions as Column expressions: nothing here leaves the JVM.

Every function gives null for null unless it says otherwise. White space is that of Python's str.strip, not only what `\\s` means to Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space at either end. A run of it is tried from its beginning only, so long runs inside a text cost no more than their length."""
    return F.regexp_replace(c, f"^{WS}+|(?<!{WS}){WS}++$", "")


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def plain_line(c: Column) -> Column:
    """The first line, stripped, in lower case and with single spaces."""
    return collapse(F.lower(strip(first_line(strip(c)))))


def normalize_relation(c: Column) -> Column:
    """plain_line without one pair of equal quotes; null, empty, nan, null and none become "none"."""
    bare = strip(F.regexp_replace(plain_line(c), r"^([\"'])(.*)\1$", "$2"))
    return F.coalesce(F.regexp_replace(bare, "^(?:nan|null|)$", "none"), F.lit("none"))


def normalize_plain(c: Column) -> Column:
    """Variant without quotes and none mapping; null stays empty."""
    return F.coalesce(plain_line(c), F.lit(""))


def normalize_text_null(c: Column) -> Column:
    """Variant in which null is the text "nan"."""
    return F.coalesce(plain_line(c), F.lit("nan"))


NORMALIZERS = {"n1": normalize_relation, "n2": normalize_plain, "n3": normalize_text_null, "n4": normalize_relation}


def normalize_label(c: Column) -> Column:
    """As labels are written: null-like becomes "none", else only stripped."""
    s = strip(c)
    return F.when(s.isNull() | F.lower(s).isin("", "nan", "null", "none"), "none").otherwise(s)


def label_set_label(c: Column) -> Column:
    """As label sets hold them: null and blank become "none"."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("none"))


def postprocess(c: Column) -> Column:
    """First line of an answer without a leading "answer:"; null gives an empty text."""
    line = strip(F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"^([^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*)", 1))
    return strip(F.regexp_replace(line, r"(?i)^answer\s*:\s*", ""))


def without_think(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", "")


def postprocess_think(c: Column) -> Column:
    """First line with text after think blocks, closed or not, are taken out; without a leading "answer:"."""
    lines = F.transform(F.split(without_think(F.coalesce(c, F.lit(""))), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip)
    line = F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))
    return strip(F.regexp_replace(line, r"(?i)^answer\s*:\s*", ""))


def prompt_hash(c: Column) -> Column:
    """First 12 hexadecimal digits of the MD5 of the UTF-8 text; null hashes as "nan"."""
    return F.substring(F.md5(F.coalesce(c, F.lit("nan"))), 1, 12)


def zero_shot_suffix(c: Column) -> Column:
    return F.concat(strip(c), F.lit("\nAnswer: "))


def allowed_labels(c: Column) -> Column:
    """Aggregate: the distinct labels, stripped, without blanks, sorted and joined."""
    s = strip(c)
    return F.array_join(F.array_sort(F.collect_set(F.when(s != "", s))), ", ")


def system_prompt(template: Column, labels: Column) -> Column:
    return F.replace(template, F.lit("{allowed_labels}"), labels)


MESSAGES = "array<struct<role:string,content:string>>"
# From where the last match ended: what fails there fails at every later place, and need not be tried there.
DEMO = r"\G(?s)(.*?)\r?\nAnswer:\s*(.*?)(?:\r?\n\r?\n|$)"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: functions of arrays are not part of generated code, where equal expressions are shared."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unravel(c: Column) -> Column:
    """A few-shot prompt as messages array<struct<role, content>>: demonstrations in turn, then the query. Demonstrations without text or label are left out."""
    mark = "Now you try:"
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    ended = lambda u: F.when(u.endswith("Answer:"), u).otherwise(F.concat(u, F.lit("\nAnswer:")))

    def demonstration(d: Column) -> Column:
        both = F.struct(strip(F.regexp_extract(d, DEMO, 1)).alias("u"), strip(F.regexp_extract(d, DEMO, 2)).alias("a"))
        return let(both, lambda z: F.when((z["u"] != "") & (z["a"] != ""), F.array(turn("user", ended(z["u"])), turn("assistant", z["a"]))).otherwise(F.array().cast(MESSAGES)))

    def whole(text: Column) -> Column:
        demos = F.flatten(F.transform(F.regexp_extract_all(strip(F.substring_index(text, mark, 1)), F.lit(DEMO), F.lit(0)), demonstration))
        final = strip(F.substring(text, F.instr(text, mark) + len(mark), F.length(text)))
        last = let(final, lambda x: F.when(x != "", x).otherwise(text))
        return F.when(F.contains(text, F.lit(mark)), F.concat(demos, F.array(turn("user", last)))).otherwise(F.array(turn("user", text)))

    return let(strip(F.coalesce(c, F.lit(""))), whole)


def chat_text(system: Column, messages: Column) -> Column:
    """Plain rendering of a conversation: the system text, then each message; models with templates bring their own function."""
    body = F.array_join(F.transform(messages, lambda m: m["content"]), "\n\n")
    return F.concat(system, F.lit("\n\n"), body, F.lit("\n"))


def quoted(c: Column) -> Column:
    """The text as a regular expression for itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")


def find_span(text: Column, mention: Column) -> Column:
    """struct<begin, end>: where the mention first stands in the text, its words apart by any white space if need be; -1 for both if nowhere."""
    m = strip(mention)
    at = F.position(m, text)
    loose = F.array_join(F.transform(F.filter(F.split(m, f"{WS}+"), lambda x: x != ""), quoted), WS + "*")
    found = F.regexp_substr(text, loose)
    where = F.position(found, text)
    none = F.struct(F.lit(-1).alias("begin"), F.lit(-1).alias("end"))
    exact = F.struct((at - 1).alias("begin"), (at - 1 + F.length(m)).alias("end"))
    near = F.struct((where - 1).alias("begin"), (where - 1 + F.length(found)).alias("end"))
    return F.when(F.coalesce(m, F.lit("")) == "", none).when(at > 0, exact).when(found.isNotNull(), near).otherwise(none)


def mark_entities(text: Column, e1: Column, e2: Column, t1: Column, t2: Column, typed: bool = True) -> Column:
    """The text with both mentions marked where they stand, or put at its end if one is not found or they overlap."""
    s = F.coalesce(text, F.lit("None"))
    opener = lambda tag, t: F.when(F.coalesce(t, F.lit("")).isin("", "None") | F.lit(not typed), f"[{tag}]").otherwise(F.concat(F.lit(f"[{tag}] "), t, F.lit(" :")))
    o1, o2 = opener("E1", t1), opener("E2", t2)
    a, b = find_span(s, e1), find_span(s, e2)
    apart = (a["end"] <= b["begin"]) | (b["end"] <= a["begin"])
    cut = lambda i, j: F.substring(s, i + 1, j - i)

    def inline(p, po, pt, q, qo, qt):
        return F.concat(cut(F.lit(0), p["begin"]), F.lit(" "), po, F.lit(" "), cut(p["begin"], p["end"]), F.lit(f" [/{pt}] "), cut(p["end"], q["begin"]), F.lit(" "), qo, F.lit(" "), cut(q["begin"], q["end"]), F.lit(f" [/{qt}] "), cut(q["end"], F.length(s)))

    end = F.concat(s, F.lit(" "), o1, F.lit(" "), F.coalesce(e1, F.lit("None")), F.lit(" [/E1] "), o2, F.lit(" "), F.coalesce(e2, F.lit("None")), F.lit(" [/E2]"))
    missing = (a["begin"] < 0) | (b["begin"] < 0) | ~apart
    return F.when(missing, end).when(a["begin"] < b["begin"], inline(a, o1, "E1", b, o2, "E2")).otherwise(inline(b, o2, "E2", a, o1, "E1"))


def extract_sentence(c: Column) -> Column:
    """The sentence a prompt is about: after "Sentence:", else the first quoted run of 20 characters, else the first long line, else the opening."""
    named = strip(F.regexp_extract(c, r'Sentence:\s*"([^"]+)"', 1))
    quote = strip(F.regexp_extract(c, r'"([^"]{20,})"', 1))
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: (F.length(x) > 30) & ~x.startswith("You are") & ~x.startswith("Extract"))
    line = F.left(F.try_element_at(lines, F.lit(1)), F.lit(200))
    has = lambda p: F.regexp_like(c, F.lit(p))
    return F.when(has(r'Sentence:\s*"[^"]+"'), named).when(has(r'"[^"]{20,}"'), quote).otherwise(F.coalesce(line, F.left(c, F.lit(200))))


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def run_name(owner: str, model: Column, regime: Column, shot: Column) -> Column:
    return F.concat(F.lit(owner + "/"), model, F.lit("-"), regime, F.lit("-"), shot.cast("int").cast("string"), F.lit("-shot"))


def short_key(c: Column) -> Column:
    return F.left(F.lower(F.split_part(c, F.lit("-"), F.lit(1))), F.lit(7))


def is_negative(c: Column, labels: list[str]) -> Column:
    return F.lower(strip(c)).isin(labels)
