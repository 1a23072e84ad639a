"""Settings and environments: flat key-value texts, files with includes, templates with holes; of one file in the driver, or of a column."""

from __future__ import annotations

import json
import os
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings and the environment variables that override them.
SETTINGS = {"mode": "FIREWALL_MODE", "llm_endpoint": "LLM_ENDPOINT", "llm_timeout": "LLM_TIMEOUT", "log_path": "FEEDBACK_LOG_PATH", "threshold": "BLOCK_THRESHOLD", "shadow": "SHADOW_MODE"}


def flat_yaml(text: str) -> dict[str, str]:
    """``key: value`` lines; comments and quotes go, nesting is an error."""
    out = {}
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0].isspace() or ":" not in line:
            raise ValueError(f"line {n}: nested or malformed")
        key, value = line.split(":", 1)
        out[key.strip()] = re.sub(r"\s+#.*$", "", value).strip().strip("'\"")
    return out


def load_settings(text: str, defaults: dict[str, str], env: dict[str, str] | None = None) -> dict[str, str]:
    """The environment wins over the file, the file over the defaults."""
    env = os.environ if env is None else env
    have = {**defaults, **flat_yaml(text)}
    return {k: env.get(var, have.get(k, "")) for k, var in SETTINGS.items()}


def load_yaml(path: str):
    """YAML with ``!include`` of YAML, JSON or text files, relative to the file that includes them."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def include(loader, node):
        target = os.path.join(os.path.dirname(path), loader.construct_scalar(node))
        if target.endswith((".yaml", ".yml")):
            return load_yaml(target)
        with open(target, encoding="utf-8") as f:
            return json.load(f) if target.endswith(".json") else f.read()

    Loader.add_constructor("!include", include)
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, Loader)


def inject(template: str, defaults: dict[str, str], injections: dict[str, str]) -> str:
    """The template with its holes filled; only known holes may be given."""
    if unknown := set(injections) - set(defaults):
        raise ValueError(f"unknown injections: {sorted(unknown)}")
    holes = {f for _, f, _, _ in string.Formatter().parse(template) if f}
    return template.format(**{k: v for k, v in {**defaults, **injections}.items() if k in holes})


def flat_yaml_map(text: Column) -> Column:
    """:func:`flat_yaml` of a column as a map; of equal keys the last counts, and a text with a nested or malformed line has no map."""
    lines = F.filter(F.split(text, "\\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    clean = lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+#.*$", "")), "^['\"]+|['\"]+$", "")
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), clean(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("value"))
    entries = F.transform(lines, pair)
    later = lambda e, i, x: F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])
    last = F.get(F.transform(F.array(entries), lambda e: F.filter(e, lambda x, i: ~later(e, i, x))), F.lit(0))
    bad = F.exists(lines, lambda x: x.rlike(r"^\s") | ~x.contains(":"))
    return F.when(~bad, F.map_from_entries(last))


def settings_struct(file: Column, env: Column, defaults: dict[str, str]) -> Column:
    """The settings of a row: its environment (a map of variables) wins over its file's map, that over the defaults."""
    value = lambda k, var: F.coalesce(F.try_element_at(env, F.lit(var)), F.try_element_at(file, F.lit(k)), F.lit(defaults.get(k, "")))
    return F.struct(*[value(k, var).alias(k) for k, var in SETTINGS.items()])


def injected(template: Column, injections: Column, defaults: dict[str, str]) -> Column:
    """:func:`inject` of a column; ``injections`` is a map, and a row that gives an unknown hole has no text."""
    known = F.map_from_arrays(F.array(*map(F.lit, defaults)), F.array(*map(F.lit, defaults.values())))
    holes = F.array(*map(F.lit, defaults))
    unknown = F.size(F.array_except(F.map_keys(injections), holes)) > 0
    fill = lambda text, k: F.replace(text, F.concat(F.lit("{"), k, F.lit("}")), F.coalesce(F.try_element_at(injections, k), F.element_at(known, k)))
    return F.when(~unknown, F.aggregate(holes, template, fill))


def with_includes(df: DataFrame, key: str, text: str, files: DataFrame, name: str = "name", content: str = "content", depth: int = 3) -> DataFrame:
    """``df`` with each ``!include file`` in ``text`` replaced by that file's content, up to ``depth`` levels; unknown files stay as they stand.

    Files are joined by name, once a level, so neither texts nor files pass through the driver. ``key`` names a row.
    """
    mark = r"!include\s+(\S+)"
    held = files.select(F.col(name).alias("_name"), F.col(content).alias("_content"))
    for _ in range(depth):
        asked = df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(mark), F.lit(1)))).alias("_name"))
        found = asked.join(held, "_name").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_content"))).alias("_files"))
        pieces = F.split(F.col(text), r"(?=!include\s)")  # each piece but the first starts with a mark
        known = lambda x: F.try_element_at(F.col("_files"), F.regexp_extract(x, "^" + mark, 1))
        whole = F.transform(pieces, lambda x: F.when(known(x).isNotNull(), F.concat(known(x), F.regexp_replace(x, "^" + mark, ""))).otherwise(x))
        df = df.join(found, F.col(key) == F.col("_key"), "left").withColumn(text, F.when(F.col("_files").isNull(), F.col(text)).otherwise(F.array_join(whole, ""))).drop("_key", "_files")
    return df
