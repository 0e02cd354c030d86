import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T

EDGE = [None, "", "  ", "NaN", "null", "None", "none", "NA", '"Foo  Bar"', "'x'", '"', "''", '"a\'', "a\nb", "\r\nA\tB c", "a b", "  x ", "x y", "x" * 70, "Answer: x", "<think>a</think>\n\nB", "<think>open", "İx", "ΟΔΟΣ", "\x1cz\x85", '" q "', "two\r\nlines", "a\x0bb"]


def plain_line(t):
    return re.sub(r"\s+", " ", str(t).strip().split("\n")[0].strip().lower())


def normal(t):
    x = plain_line("" if t is None else t)
    if len(x) >= 2 and x[0] == x[-1] and x[0] in "\"'":
        x = x[1:-1].strip()
    return "none" if x in ("", "nan", "null", "none") else x


def answer(t, think=False):
    x = t or ""
    if think:
        x = re.sub(r"<think>.*$", "", re.sub(r"<think>.*?</think>", "", x, flags=re.S | re.I), flags=re.S | re.I)
        x = next((y.strip() for y in x.splitlines() if y.strip()), "")
    else:
        x = (x.strip().splitlines() or [""])[0].strip()
    return re.sub(r"^answer\s*:\s*", "", x, flags=re.I).strip()


WANT = {
    "normalize_relation": normal, "normalize_plain": lambda t: "" if t is None else plain_line(t), "normalize_text_null": lambda t: "nan" if t is None else plain_line(t),
    "normalize_label": lambda t: "none" if t is None or t.strip().lower() in ("", "nan", "null", "none") else t.strip(), "label_set_label": lambda t: (t or "").strip() or "none",
    "postprocess": answer, "postprocess_think": lambda t: answer(t, True), "prompt_hash": lambda t: hashlib.md5(("nan" if t is None else t).encode()).hexdigest()[:12],
}


@pytest.mark.parametrize("name", WANT)
def test_against_plain_python(spark, name):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(EDGE)], "k int, x string")
    got = {r.k: r.y for r in df.select("k", getattr(T, name)(F.col("x")).alias("y")).collect()}
    assert got == {k: WANT[name](x) for k, x in enumerate(EDGE)}


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("y")).first()["y"]


def test_unravel(spark):
    u = lambda p: [(m["role"], m["content"]) for m in one(spark, T.unravel(F.col("p")), p=p)]
    two = "Foo\nA?\nAnswer: x\n\nBar\r\nAnswer: y\r\n\r\nNow you try:\nQ\nAnswer:"
    assert u(two) == [("user", "Foo\nA?\nAnswer:"), ("assistant", "x"), ("user", "Bar\nAnswer:"), ("assistant", "y"), ("user", "Q\nAnswer:")]
    assert u(" Q\nAnswer: ") == [("user", "Q\nAnswer:")]
    assert u("A\nAnswer: \n\nNow you try:\nQ") == [("user", "Q")]
    assert u("A\nAnswer: b\n\nNow you try:  ") == [("user", "A\nAnswer:"), ("assistant", "b"), ("user", "A\nAnswer: b\n\nNow you try:")]
    assert u(None) == [("user", "")]


@pytest.mark.parametrize(
    ("text", "a", "b", "t1", "t2", "want"),
    [
        ("Ann met Bo.", "Ann", "Bo", "P", None, " [E1] P : Ann [/E1]  met  [E2] Bo [/E2] ."),
        ("Bo met Ann  Lee.", "Ann Lee", "Bo", None, "P", " [E2] P : Bo [/E2]  met  [E1] Ann  Lee [/E1] ."),
        ("Ann met Bo.", "Ann", "Cy", None, None, "Ann met Bo. [E1] Ann [/E1] [E2] Cy [/E2]"),
        ("Ann Lee", "Ann Lee", "Lee", None, None, "Ann Lee [E1] Ann Lee [/E1] [E2] Lee [/E2]"),
        ("At (X.Y) in W+", "X.Y", "W+", None, None, "At ( [E1] X.Y [/E1] ) in  [E2] W+ [/E2] "),
    ],
)
def test_mark_entities(spark, text, a, b, t1, t2, want):
    c = T.mark_entities(*[F.col(x) for x in ("text", "a", "b", "t1", "t2")])
    assert one(spark, c, text=text, a=a, b=b, t1=t1, t2=t2) == want


def test_sentences_and_names(spark):
    e = lambda p: one(spark, T.extract_sentence(F.col("p")), p=p)
    assert e('x\nSentence: "A b."\ny') == "A b."
    assert e('say "aaaaaaaaaaaaaaaaaaaaaaa" now') == "a" * 23
    assert e("You are a helper that reads long lines\nshort\n" + "z" * 250) == "z" * 200
    assert e("tiny") == "tiny" and e(None) is None
    assert one(spark, T.run_name("o", F.col("m"), F.col("r"), F.col("s")), m="M-1", r="re", s="2") == "o/M-1-re-2-shot"
    assert one(spark, T.short_key(F.col("m")), m="SmolLM2long-3") == "smollm2"
    assert one(spark, T.chat_text(F.lit("sys"), T.unravel(F.col("p"))), p="q") == "sys\n\nq\n"
