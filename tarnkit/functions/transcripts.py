"""Speech recogniser output: log lines out, tags out; durations and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnkit.functions.text import trim_space

# What marks a recogniser's log line, in lower case.
LOG_MARKS = (
    "processing time", "encoder processing", "decoder processing", "model path", "model loaded", "thread", "cmvn", "rtf", "real-time factor", "gpu", "cpu", "gguf", "ggml", "sense-voice", "sensevoice",
    "rapidspeech", "rs-asr", "loading model", "初始化", "加载模型", "线程", "回退", "fallback", "[rs-cli]", "[info", "[warn", "[error", "[debug", "starting inference", "finished", "loading audio", "loaded ",
    "compute features", "encoder takes", "decoder takes", "samples @",
)
RESULT = "(?s)Result:(.*)$"


def is_log_line(line: Column) -> Column:
    low = F.lower(line)
    marked = F.lit(False)
    for mark in LOG_MARKS:
        marked = marked | low.contains(mark)
    return marked | line.rlike(r"^\[[0-9].{4,}") | line.rlike(r'(?s)^[0-9]\.[^:]*:\s*[0-9"-]')


def transcript(raw: Column) -> Column:
    """The spoken lines of a recogniser's output."""

    def clean(x: Column) -> Column:
        return trim_space(F.regexp_replace(x, r"(?s)<\|.*?\|>", ""))

    lines = F.filter(F.transform(F.split(raw, "\n", -1), trim_space), lambda x: x != "")
    result = lambda x: F.lower(x).contains("[rs-cli]") & x.contains("Result:")
    spoken = F.transform(F.filter(lines, lambda x: result(x) | ~is_log_line(x)), lambda x: clean(F.when(result(x), F.regexp_extract(x, RESULT, 1)).otherwise(x)))
    return F.array_join(F.filter(spoken, lambda x: x != ""), "\n")


def duration_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS.xx, null if it is none."""
    pattern = r"([0-9]{2,}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)"
    h, m, s = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2, 3))
    return h * 3600 + m * 60 + s
