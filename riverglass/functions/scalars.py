"""Scalar functions on travel paths, names, boxes and probability arrays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of the words in experiment, pipeline, task, device and metric names.
ABBREVIATIONS = {
    "batch": "batch",
    "server": "serv",
    "onprem": "onp",
    "agxavier": "agx",
    "orinagx": "oagx",
    "orinnx": "onx",
    "orinano": "orn",
    "nxavier": "nx",
    "datasource": "dsrc",
    "traffic": "trfc",
    "building": "bldg",
    "people": "ppl",
    "indoor": "ind",
    "merged": "mrgd",
    "mergedtraffic": "mrgdtrfc",
    "mergedpeople": "mrgdppl",
    "yolov5": "y5",
    "yolov5n": "y5n",
    "yolov5s": "y5s",
    "yolov5m": "y5m",
    "yolov5l": "y5l",
    "yolov5x": "y5x",
    "yolov5ndsrc": "y5nd",
    "retina": "rt",
    "multiface": "mf",
    "retina1face": "rt1f",
    "retinamtface": "rt_mf",
    "retinamtfacedsrc": "rtmfd",
    "age": "age",
    "arcface": "arcf",
    "carbrand": "cbrd",
    "carcolor": "ccol",
    "cardamage": "cdmg",
    "firedetect": "fire",
    "fashioncolor": "fcol",
    "gender": "gndr",
    "emotion": "emtn",
    "emotionnet": "emtn",
    "platedet": "pldt",
    "dynamic": "dyn",
    "movenet": "move",
    "3090": "39",
    "1080": "18",
    "fp32": "32",
    "fp16": "16",
    "int8": "8",
}


def hop_field(path: Column, hop: int, field: int) -> Column:
    """Field ``field`` (from 0) of hop ``hop`` (from 0) of a path ``[a|b|..][a|b|..]``; null where there is none."""
    part = F.get(F.split(path, r"\]"), F.lit(hop))
    return F.get(F.split(F.ltrim(part, F.lit("[")), r"\|"), F.lit(field))


def frame_id(path: Column) -> Column:
    return hop_field(path, 0, 2).try_cast("long")


def origin_stream(path: Column) -> Column:
    return hop_field(path, 0, 1)


def sender_host(path: Column) -> Column:
    """Host of the second-to-last ``[`` part: the hop before this one, empty on the first hop."""
    parts = F.split(path, r"\[")
    part = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    return F.get(F.split(F.get(F.split(part, r"\]"), F.lit(0)), r"\|"), F.lit(0))


def arrival_package_size(path: Column) -> Column:
    """Last field of the last hop."""
    return F.regexp_extract(path, r"\|([0-9]+)\][^\[]*$", 1).try_cast("long")


def append_hop(path: Column, host: Column, container: Column, count: Column, *fields: Column) -> Column:
    rest = F.concat_ws("|", host, container, count, *fields)
    return F.concat(path, F.lit("["), rest, F.lit("]"))


def split_any(text: Column, delimiters: str) -> Column:
    """Split on any of the delimiter characters; empty parts stay."""
    escaped = "".join(f"\\{c}" for c in delimiters)
    return F.split(text, f"[{escaped}]", -1)


def abbreviate(phrase: Column, delimiter: str = "_", words: dict[str, str] | None = None) -> Column:
    """Every word by the dictionary, else its stem by the dictionary with the trailing digits kept, else its first four letters.

    No delimiter follows a word that equals the last one.
    """
    known = F.create_map(*[F.lit(x) for pair in (words or ABBREVIATIONS).items() for x in pair])

    def short(word: Column) -> Column:
        stem = F.regexp_replace(word, "[0-9]+$", "")
        return F.coalesce(known[word], F.concat(known[stem], F.regexp_extract(word, "([0-9]*)$", 1)), F.substring(word, 1, 4))

    parts = F.split(phrase, f"\\{delimiter}")
    ends = lambda word: F.when(word == F.element_at(parts, -1), "").otherwise(delimiter)
    return F.array_join(F.transform(parts, lambda word: F.concat(short(word), ends(word))), "")


def object_class(head: Column) -> Column:
    return F.when(head.contains("retina") | head.contains("movenet"), "people").otherwise("cars")


def remove_substring(text: Column, part: str) -> Column:
    """Remove the first ``part`` until there is none, as removals can form it anew: at most one step per length of ``part``."""
    if not part:
        return text
    steps = F.sequence(F.lit(0), F.floor(F.length(text) / len(part)).cast("int"))

    def erase(s: Column, _: Column) -> Column:
        at = F.instr(s, F.lit(part))
        return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + len(part), F.length(s)))).otherwise(s)

    return F.aggregate(steps, text, erase)


def fraction(text: Column) -> Column:
    """'a/b' as a number; 0 if b is 0."""
    a, b = (F.get(F.split(text, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def align(at: Column, width: int = 1_000_000) -> Column:
    """Start of the bin of ``width`` that holds ``at``."""
    return (F.floor(at / width) * width).cast("long")


def minutes_since(at: Column, first: Column) -> Column:
    return (at - first) / F.lit(60e6)


def host_type(host: Column) -> Column:
    return F.when(host.contains("virtual") | host.contains("server"), "serv").otherwise(abbreviate(host))


def table_task(task: Column) -> Column:
    """Task names as tables carry them: detector variants lose their last letter, other names a trailing digit."""
    return F.when(task.rlike("^yolov5.$"), F.regexp_replace(task, ".$", "")).otherwise(F.regexp_replace(task, "[0-9]$", ""))


def default_package_size(model: Column) -> Column:
    side = F.when(model.contains("320"), 320).when(model.contains("512"), 512).otherwise(640)
    return (side * side * 3).cast("long")


def corner_form(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def centre_form(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1]


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def softmax(values: Column) -> Column:
    e = F.transform(values, lambda x: F.exp(x.cast("double") - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values).cast("double")
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(x + 1e-10))
