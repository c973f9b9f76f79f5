"""Named relations: each is one SELECT over others, in Spark SQL.

An analysis is a graph of relations; `build` makes the DataFrame of one, with all it needs. Relations marked `stored`
feed many others, or come from a generator (whose size Spark can't tell) and are joined; they are written once to the shared folder, so that
regular expressions over html run once a page and joins know their sides. Catalyst plans each
SELECT together with what it reads.

`duckdb_sql` gives the same relation as one ANSI query with common table expressions, spelled for DuckDB.

A relation may have words for Spark alone (`spark`), which give the same rows by a plan that suits a cluster; DuckDB keeps `sql`. `$tasks$` in them
is a number of partitions that follows the rows of the sample.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sightline.session import durable

#: Tables that are read, not derived.
BASE = "region nation customer supplier part orders lineitem events pages".split()

#: Thresholds of the profiles (fixed values).
THRESHOLDS = {
    "render_spa_max_words": 120, "render_spa_hard_max_words": 60, "render_script_ratio": 4, "render_thin_words": 50, "render_thin_html": 2000,
    "alt_missing_ratio": 0.30, "alt_missing_min": 3, "text_in_image_min_images": 5, "text_in_image_max_words": 120, "text_in_image_min_html": 3000,
    "pdf_link_min": 3, "stale_days": 730, "recent_signal_days": 400, "page_weight_bytes": 1_500_000, "page_weight_scripts": 40, "slow_ms": 3000,
    "wall_words": 900, "wall_max_headings": 1, "deadend_min_links": 3, "deep_path_segments": 3, "deep_min_pages": 3, "viewport_min_fraction": 0.5,
    "render_blocking_head_max": 6, "generic_link_min": 4, "login_wall_min_pages": 2, "unlabeled_controls_min": 2,
}
PROFILES = {
    "balanced": {},
    "strict": {"render_spa_max_words": 160, "render_thin_words": 80, "alt_missing_ratio": 0.20, "slow_ms": 2000, "page_weight_bytes": 1_200_000, "wall_words": 700, "stale_days": 540},
    "lenient": {"render_spa_max_words": 80, "render_thin_words": 30, "alt_missing_ratio": 0.50, "slow_ms": 5000, "page_weight_bytes": 2_500_000, "wall_words": 1200, "stale_days": 1095},
}


@dataclass(frozen=True)
class Settings:
    """What a run may choose: threshold profile, pages sampled per site, site scope (host or domain) and the day it is."""

    profile: str = "balanced"
    max_pages: int = 12
    scope: str = "host"
    as_of: str = "2025-06-01"
    overrides: dict = field(default_factory=dict)

    def values(self) -> dict[str, str]:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}; choose from {sorted(PROFILES)}")
        if self.scope not in ("host", "domain"):
            raise ValueError(f"unknown scope {self.scope!r}; choose host or domain")
        t = THRESHOLDS | PROFILES[self.profile] | self.overrides
        return {k: str(v) for k, v in t.items()} | {"max_pages": str(int(self.max_pages)), "site": "bare_host" if self.scope == "host" else "domain", "as_of": f"DATE '{self.as_of}'"}


@dataclass(frozen=True)
class Relation:
    name: str
    sql: str
    stored: bool = False
    duck: str = ""
    spark: str = ""
    replaces: str = ""
    tasks_by: str = ""
    kept: bool = False
    shown: str = ""

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(NAMED.findall(self.sql)))

    def words(self, tables) -> str:
        """What Spark runs: `spark`, unless the relation that it replaces is among the tables given."""
        return self.spark if self.spark and self.replaces not in tables else self.sql


NAMED = re.compile(r"(?<!x)\{([a-z][a-z_0-9]*)\}")
SETTING = re.compile(r"\$([a-z_]+)\$")
GROUP_NUMBER = re.compile(r"\$back(\d)\$")  # a group of the match, in a replacement
RELATIONS: dict[str, Relation] = {}


def relation(name: str, sql: str, stored: bool = False, duck: str = "", spark: str = "", replaces: str = "", tasks_by: str = "", kept: bool = False, shown: str = "") -> None:
    """`duck` is the relation in DuckDB's own words, written apart from `sql`; without it, `sql` is respelled.

    `spark` stands in for `sql` in Spark. It may read the base tables in place of the relation `replaces`, and is left out where that one is given as a
    table. `tasks_by` names the stored relation whose rows `$tasks$` follows. `kept` relations are written once as stored ones are, in Spark alone: what
    many others read and takes long to make. `shown` is the name that DuckDB's SQL has for it, where that isn't its own; no chain may hold two of one name.
    """
    RELATIONS[name] = Relation(name, sql.strip(), stored, duck.strip(), spark.strip(), replaces, tasks_by, kept, shown)


#: Sampled pages in a task: html shrinks so much in files and shuffles that partitions by bytes would hold hundreds of thousands of pages each.
TASK_PAGES = 2000


def tasks(spark: SparkSession, rows: int) -> int:
    return max(3 * spark.sparkContext.defaultParallelism if rows > TASK_PAGES else 1, -(-rows // TASK_PAGES))


def build(spark: SparkSession, name: str, tables: dict[str, DataFrame], settings: Settings | None = None, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of a relation. `tables` gives base tables, or stands in for any relation."""
    made = {} if made is None else made
    if name in tables:
        return tables[name]
    if name not in made:
        r, values = RELATIONS[name], (settings or Settings()).values()
        words, views = r.words(tables), {}
        for i in dict.fromkeys(NAMED.findall(words)):
            views[i] = f"sl_{uuid.uuid4().hex}"
            build(spark, i, tables, settings, made).createOrReplaceTempView(views[i])
        if "$tasks$" in words:
            values["tasks"] = str(tasks(spark, build(spark, r.tasks_by, tables, settings, made).count()))
        text = SETTING.sub(lambda m: values[m[1]], NAMED.sub(lambda m: views[m[1]], words))
        df = spark.sql(GROUP_NUMBER.sub(r"$\1", text))
        for v in views.values():
            spark.catalog.dropTempView(v)
        made[name] = durable(df) if r.stored or r.kept else df
    return made[name]


def order(name: str, done: list[str] | None = None) -> list[str]:
    """A relation and all it needs, each after its inputs."""
    done = [] if done is None else done
    for i in RELATIONS[name].inputs:
        if i in RELATIONS and i not in done:
            order(i, done)
    if name not in done:
        done.append(name)
    return done


def scoped(names: list[str], prefix: str, instead: dict[str, str]) -> None:
    """Registers the relations `names`, and all that they need, again as <prefix><name>, reading the relations `instead` names for some."""

    def reach(read: Callable[[Relation], str]) -> tuple[dict[str, bool], Callable[[str], str]]:
        """What is registered again, if relations are worded as `read` has it, and the new names put into such words."""
        moved: dict[str, bool] = {}

        def reaches(name: str) -> bool:
            if name not in moved:
                moved[name] = name in instead or name in RELATIONS and any([reaches(i) for i in NAMED.findall(read(RELATIONS[name]))])
            return moved[name]

        for n in names:
            reaches(n)
        return moved, lambda sql: NAMED.sub(lambda m: "{" + (instead.get(m[1]) or (prefix + m[1] if reaches(m[1]) else m[1])) + "}", sql)

    _, named = reach(lambda r: r.sql)
    moved, named_for_spark = reach(lambda r: r.sql + r.spark)
    for n in [n for n, x in moved.items() if x and n not in instead]:
        r = RELATIONS[n]
        tasks_by = r.tasks_by and named_for_spark("{" + r.tasks_by + "}")[1:-1]
        words = named_for_spark(r.spark or r.sql)
        relation(prefix + n, named(r.sql), r.stored, named(r.duck), words if r.spark or words != named(r.sql) else "", r.replaces, tasks_by, r.kept)


#: Spark's spelling and DuckDB's.
SPELLING = [
    (r"\br'", "'"), (r"/\*all\*/ 1\)", "'g')"), (r"\bregexp_like\(", "regexp_matches("), (r"\bsplit\(", "regexp_split_to_array("), (r"\btransform\(", "list_transform("),
    (r"\bfilter\(", "list_filter("), (r"\b([a-z]) -> ", r"lambda \1: "), (r"\bsize\(", "len("), (r"\barray\(", "list_value("), (r"\bcollect_list\(", "list("),
    (r"\btry_element_at\(", "list_extract("), (r"\barrays_overlap\(", "list_has_any("), (r"\barray_join\(", "array_to_string("), (r"\boctet_length\(", "strlen("),
    (r"\bstartswith\(", "starts_with("), (r"\bendswith\(", "ends_with("), (r"\bbround\(", "round_even("), (r"\bjson_object_keys\(", "json_keys("), (r"\bget_json_object\(", "json_extract_string("),
    (r"\btry_parse_json\((\w+)\) IS NOT NULL", r"json_valid(\1)"), (r"\bfrom_json\((\w+), 'array<string>'\)", r"json_extract_string(\1, '$[*]')"), (r"\bdatediff\(([^(),]+), ([^(),]+)\)", r"date_diff('day', \2, \1)"),
    (r"\bposexplode\((\w+)\) AS \((\w+), (\w+)\)", r"generate_subscripts(\1, 1) - 1 AS \2, unnest(\1) AS \3"), (r"\bexplode\(", "unnest("), (r"\bcast\(NULL AS string\)", "NULL::varchar"),
    (r"\blistagg\(([^()]+), ('[^']*'|chr\(10\))\) WITHIN GROUP \(ORDER BY ([^()]+)\)", r"string_agg(\1, \2 ORDER BY \3)"), (r"\bsequence\(([^(),]+), ([^()]+)\)", r"generate_series(\1, \2)"), (r"\bto_date\(", "date("), (r"\bsha2\((.+?), 256\)", r"sha256(\1)"),
    (r"\bDISTRIBUTE BY \w+ SORT BY \w+", ""), (r"\bslice\(", "list_slice("), (r"\barray_sort\(", "list_sort("), (r"\barray_max\(", "list_max("), (r"\barray_min\(", "list_min("), (r"\barray_distinct\(", "list_distinct("), (r"\bformat_string\(", "printf("),
]


def cte(name: str) -> str:
    return f"r_{RELATIONS[name].shown or name}" if name in RELATIONS else f"r_{name}"


def chain(names: list[str], sql: str, settings: Settings | None = None) -> str:
    """DuckDB's SQL with the named relations, and all they need, as r_<name> before `sql`, which is in DuckDB's own words."""
    values = (settings or Settings()).values()
    done: list[str] = []
    for n in names:
        order(n, done)
    parts = []
    for n in done:
        own = RELATIONS[n].duck
        text = SETTING.sub(lambda m: values[m[1]], NAMED.sub(lambda m: m[1] if m[1] in BASE else cte(m[1]), own or RELATIONS[n].sql))
        text = GROUP_NUMBER.sub(r"\\\1", text)
        for pattern, to in SPELLING if not own else ():
            text = re.sub(pattern, to, text)
        kind = " AS MATERIALIZED" if RELATIONS[n].stored else " AS"
        parts.append(f"{cte(n)}{kind} (\n{text}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + SETTING.sub(lambda m: values[m[1]], f"SELECT * FROM (\n{sql}\n)")


def duckdb_sql(name: str, settings: Settings | None = None) -> str:
    return chain([name], f"SELECT * FROM {cte(name)}", settings)
