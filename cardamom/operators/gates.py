"""Data gates of a release: what its tables hold, from one aggregate a table, against fixed limits and rules."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aliases
from .releases import CAPS

# Tables that a release must have, and problems of audio rows in order of their test.
REQUIRED_TABLES = ("card_definition content_key_alias content_search_fts example phrase release_unit sense unit word").split()
PROBLEMS = ("missing", "hashMismatch", "unvalidated", "badHeader")


def well_formed(table: str) -> Column:
    """Is the key of a content row a SHA-256 in lower case, or else (cards excepted) the dotted key of its own columns? False for null."""
    own = {"word": ("w", "unit_key", "source_order", "headword"), "sense": ("s", "word_key", "sense_order"), "phrase": ("ph", "word_key", "source_order"), "example": ("ex", "word_key", "source_order")}
    key = F.col("content_card_key" if table == "card_definition" else f"{table}_key")
    digest = key.rlike(r"^[0-9a-f]{64}\z")
    if table not in own:
        return F.coalesce(digest, F.lit(False))
    kind, *columns = own[table]
    parts = [F.format_string("%04d", c) if table == "word" and c == "source_order" else F.col(c).cast("string") for c in columns]
    dotted = reduce(lambda a, b: F.concat(a, F.lit("."), b), parts, F.lit(kind))
    return F.coalesce(digest, F.lit(False)) | F.coalesce(key == dotted, F.lit(False))


def wav_header(content: Column) -> Column:
    """struct<valid, sample_rate_hz> of a WAV file: RIFF chunks that all fit, PCM format, data that isn't empty. Other chunks may stand before and between."""

    @F.pandas_udf("valid boolean, sample_rate_hz long")
    def read(files: pd.Series) -> pd.DataFrame:
        def one(b: bytes | None) -> tuple[bool, int]:
            if b is None or len(b) < 12 or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
                return False, 0
            at, rate, pcm, data = 12, 0, False, False
            while at + 8 <= len(b):
                kind, size = bytes(b[at : at + 4]), int.from_bytes(b[at + 4 : at + 8], "little")
                at += 8
                if size > len(b) - at:
                    return False, 0
                if kind == b"fmt " and size >= 16:
                    pcm, rate = int.from_bytes(b[at : at + 2], "little") == 1, int.from_bytes(b[at + 4 : at + 8], "little")
                data |= kind == b"data" and size > 0
                at += size + size % 2
            return pcm and data, rate

        return pd.DataFrame([one(b) for b in files], columns=["valid", "sample_rate_hz"])

    return read(content)


def audio_problems(assets: DataFrame, objects: DataFrame) -> DataFrame:
    """asset_key, problem (null if none) of asset rows (asset_key, content_sha256, validation, sample_rate_hz) and stored objects (asset_key, content).

    The first that holds counts: missing (no object, or one without content), hashMismatch, unvalidated, badHeader (no sound PCM header, or another rate).
    """
    # The facts of a file are taken before the join, so that no file is shuffled.
    facts = objects.select("asset_key", F.sha2("content", 256).alias("_sha"), wav_header(F.col("content")).alias("_wav"))
    rows = assets.join(facts, "asset_key", "left")
    sound = F.coalesce(F.col("_wav.valid") & (F.col("_wav.sample_rate_hz") == F.col("sample_rate_hz")), F.lit(False))
    problem = F.when(F.col("_sha").isNull(), PROBLEMS[0]).when(~F.col("_sha").eqNullSafe(F.col("content_sha256")), PROBLEMS[1]).when(
        ~F.col("validation").eqNullSafe("PASSED"), PROBLEMS[2]).when(~sound, PROBLEMS[3])
    return rows.select("asset_key", problem.alias("problem"))


def count_problems(problems: DataFrame) -> DataFrame:
    """One row: rows and the number of each problem."""
    return problems.agg(F.count("*").alias("rows"), *[F.count_if(F.col("problem") == p).alias(p) for p in PROBLEMS])


def release_facts(tables: dict[str, DataFrame], problems: DataFrame) -> DataFrame:
    """name, n: all counts that the gates need, each table aggregated once. Missing tables give none."""
    parents = {"word": ("unit_key", "unit"), "sense": ("word_key", "word"), "phrase": ("word_key", "word"), "example": ("word_key", "word"), "card_definition": ("word_key", "word")}
    parts = []

    def add(df: DataFrame, counts: dict[str, Column]) -> None:
        one = df.agg(*[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in counts.items()])
        parts.append(one.select(F.explode(F.create_map(*[x for n in counts for x in (F.lit(n), F.col(f"`{n}`"))])).alias("name", "n")))

    for table, (key, parent) in parents.items():
        if table in tables:
            rows, there = tables[table].withColumn("_formed", well_formed(table)), F.lit(True)
            if parent in tables:
                rows = rows.join(tables[parent].select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
                there = F.coalesce("_there", F.lit(False))
            add(rows, {f"rows.{table}": F.count("*"), f"malformed.{table}": F.count_if(~F.col("_formed")), f"orphans.{table}": F.count_if(F.col(key).isNotNull() & ~there)})
    if "release_unit" in tables:
        add(tables["release_unit"], {f"report.{c}": F.sum(c) for c in ("words", "cards", "examples")})
    if "content_search_fts" in tables:
        add(tables["content_search_fts"], {"rows.index": F.count("*")})
    if "content_key_alias" in tables:
        add(aliases.resolve_aliases(tables["content_key_alias"]), {"aliases": F.count_if(F.col("code").isNotNull())})
    add(problems, {"rows.audio": F.count("*")} | {f"audio.{p}": F.count_if(F.col("problem") == p) for p in PROBLEMS})
    return reduce(DataFrame.unionByName, parts)


def release_gates(tables: dict[str, DataFrame], problems: DataFrame, config_version: int | None) -> DataFrame:
    """gate, passed, details of a release's rows: schema, foreignKeys, keys, audio, capacity, all of which must pass.

    ``tables`` has the release's rows by name; ``problems`` is what ``audio_problems`` gives, ``config_version`` the settings' version, null without settings.
    A count that its table's absence leaves unknown fails its gate.
    """
    missing = [t for t in REQUIRED_TABLES if t not in tables]
    row = release_facts(tables, problems).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("f"))  # some thirty counts
    n = lambda name: F.try_element_at(F.col("f"), F.lit(name))
    content = ("word", "sense", "phrase", "example", "card_definition")
    said = lambda names: F.concat_ws(" ", *[F.concat(F.lit(label + "="), F.coalesce(c.cast("string"), F.lit("?"))) for label, c in names.items()])
    total = lambda kind, of=content: reduce(lambda a, b: a + b, [n(f"{kind}.{t}") for t in of])
    settings = config_version is not None and config_version >= 1
    orphans = {t: n(f"orphans.{t}") for t in content}
    found = {p: n(f"audio.{p}") for p in PROBLEMS}
    sizes = {"words": n("rows.word"), "cards": n("rows.card_definition"), "audio": n("rows.audio")}
    reported = {c: n(f"report.{c}") for c in ("words", "cards", "examples")}
    searchable = total("rows", content[:4])
    parity = (reported["words"] == n("rows.word")) & (reported["cards"] == n("rows.card_definition")) & (reported["examples"] == n("rows.example")) & (n("rows.index") == searchable)
    within = reduce(lambda a, b: a & b, [c <= CAPS[k] for k, c in sizes.items()])
    zero = lambda counts: reduce(lambda a, b: a & b, [c == 0 for c in counts])
    gates = [
        ("schema", F.lit(not missing and settings), F.lit(f"missing={','.join(missing)} settings={'ok' if settings else 'invalid'}")),
        ("foreignKeys", zero(orphans.values()), said(orphans)),
        ("keys", zero([total("malformed"), n("aliases")]), said({"malformed": total("malformed"), "of": total("rows"), "aliases": n("aliases")})),
        ("audio", (n("rows.audio") > 0) & zero(found.values()), said({"rows": n("rows.audio")} | found)),
        ("capacity", within & parity, said(sizes | {f"reported_{k}": c for k, c in reported.items()} | {"index": n("rows.index"), "searchable": searchable}))]
    made = F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), d.alias("details")) for g, ok, d in gates])
    return row.select(F.inline(made))
