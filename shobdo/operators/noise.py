"""Severity-graded orthographic noise N1 to N9 and the emoji conditions N10, as column expressions.

A row's draws come from md5 over a key that hashes seed, type, severity and text, so a result depends on nothing else.
Every type marks its eligible units, takes the k of least hash, k being the severity's share of them rounded at
random, and rewrites those.  What is eligible is computed before the grid of severities and seeds is joined.

Defined results: null text gives nulls; text without eligible units comes back in NFC; severities other than the
integers 1 to 5 and unknown types are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from ..functions.dialect import SPARK, Spark, Steps, bound, staged
from ..functions.text import nfc


def fraction(severity: int) -> float:
    """Severity 1 to 5 as a share; anything else (booleans, floats, strings) is an error."""
    if isinstance(severity, bool) or not isinstance(severity, int) or severity not in maps.FRACTIONS:
        raise ValueError(f"severity must be an integer from 1 to 5, not {severity!r}")
    return maps.FRACTIONS[severity]


def _check_type(noise_type: str) -> None:
    if noise_type not in maps.NOISE_TYPES:
        raise ValueError(f"unknown noise type {noise_type!r}; one of {maps.NOISE_TYPES} is needed")


def _ws(d: Spark, x: str) -> str:
    return d.like(x, f"^[{maps.WS}]+$")


def _pool(d: Spark, pools: list[list[str]]):
    """For letters exchanged within a pool: index of a letter among all pools' letters, first index and size of its pool."""
    flat = [x for p in pools for x in p]
    first, cases_lo, cases_n = 0, [], []
    for p in pools:
        cases_lo.append((first + len(p), first))
        cases_n.append((first + len(p), len(p)))
        first += len(p)

    def case(i: str, cases) -> str:
        return "CASE " + " ".join(f"WHEN {i} < {end} THEN {v}" for end, v in cases) + " END"

    return d.array(flat), lambda i: case(i, cases_lo), lambda i: case(i, cases_n)


def _draw(d: Spark, tag: str, i: str) -> str:
    return d.bits(f"md5(concat(key, '{tag}', {i}))")


def _exchange(d: Spark, pools: list[list[str]], i: str, at: str) -> str:
    """Another letter of the pool of letter number `at`, uniformly."""
    flat, lo, n = _pool(d, pools)
    j = f"({lo(at)} + CAST(floor({_draw(d, 'c', i)} * ({n(at)} - 1)) AS INT))"
    return d.get(flat, f"({j} + CASE WHEN {j} >= {at} THEN 1 ELSE 0 END)")


N3_POOLS = [maps.CONSONANTS, maps.VOWELS, maps.DIGITS]


def _base(d: Spark, c: str) -> str:
    """The letter that substitution replaces: a nukta letter whole, else the first code point."""
    two = ",".join(d.lit(x) for x in maps.NUKTA_LETTERS)
    return f"CASE WHEN substr({c},1,2) IN ({two}) THEN substr({c},1,2) ELSE substr({c},1,1) END"


def unit_steps(d: Spark, noise_type: str) -> Steps:
    """From t (NFC text): units, and e, which of them are eligible. Depends on neither severity nor seed."""
    _check_type(noise_type)
    cl = ("units", d.find_all("t", maps.CLUSTER))
    solid = ("solid", d.each("units", lambda c, i: f"NOT {_ws(d, c)}"))
    at = lambda i: f"coalesce({d.get('solid', i)}, false)"
    if noise_type in ("char_insert", "char_transpose"):
        return [cl, solid, ("e", d.each("solid", lambda x, i: f"({x} AND {at(f'{i}+1')})"))]
    if noise_type == "char_delete":
        return [cl, solid, ("e", d.each("solid", lambda x, i: f"({x} AND ({at(f'{i}+1')} OR {at(f'{i}-1')}))"))]
    if noise_type == "char_substitute":
        flat = _pool(d, N3_POOLS)[0]
        return [cl, ("num", d.each("units", lambda c, i: d.index(flat, _base(d, c)))), ("e", d.each("num", lambda x, i: f"({x} >= 0)"))]
    if noise_type == "homophone_confuse":
        flat = _pool(d, maps.HOMOPHONES)[0]
        units = ("units", d.find_all("t", r"(?s).\x{09BC}|."))
        return [units, ("num", d.each("units", lambda c, i: d.index(flat, c))), ("e", d.each("num", lambda x, i: f"({x} >= 0)"))]
    if noise_type == "matra_perturb":
        targets = "[" + "".join(maps.DROP_TARGETS) + "]"
        return [("units", d.find_all("t", "(?s).")), ("e", d.each("units", lambda c, i: d.like(c, targets)))]
    if noise_type == "conjunct_split":
        one = rf"^[^\x{{09CD}}]*{maps.CONSONANT_POINT}\x{{09CD}}{maps.CONSONANT_POINT}[^\x{{09CD}}]*$"
        return [cl, ("e", d.each("units", lambda c, i: d.like(c, one)))]
    if noise_type == "elongate":
        any_ = "[" + "".join(maps.MATRAS + maps.VOWELS) + "]"
        return [cl, ("e", d.each("units", lambda c, i: d.like(c, any_)))]
    # whitespace_error: separators as they stand, tokens in clusters
    pieces = d.find_all("t", f"[{maps.WS}]+|[^{maps.WS}]+")
    units = d.flat(d.each(pieces, lambda p, i: f"CASE WHEN {_ws(d, p)} THEN {d.one(p)} ELSE {d.find_all(p, maps.CLUSTER)} END"))
    marks = "^[" + "".join(maps.COMBINING) + "]"
    split = lambda x, i: f"({x} AND {at(f'{i}+1')} AND NOT {d.like(d.get('units', f'{i}+1'), marks)})"
    merge = lambda x, i: f"(NOT {x} AND {i} > 0 AND {i} < {d.size('units')} - 1)"
    return [("units", units), solid, ("e", d.each("solid", lambda x, i: f"({split(x, i)} OR {merge(x, i)})"))]


def eligible_count(d: Spark) -> str:
    return d.size(d.keep("e", lambda x: x))


def rewrite_steps(d: Spark, noise_type: str) -> Steps:
    """From units, e, severity, frac and seed to out, n_eligible, n_requested, n_applied, submodes."""
    share = "(n_eligible * frac)"
    steps: Steps = [
        ("n_eligible", eligible_count(d)),
        ("key", d.sha256(f"concat_ws({d.unit_sep}, CAST(seed AS STRING), '{noise_type}', CAST(severity AS STRING), t)")),
        ("n_requested", f"CAST(least(n_eligible, floor({share}) + CASE WHEN {d.bits('md5(concat(key, ' + chr(39) + 'k' + chr(39) + '))')} < {share} - floor({share}) THEN 1 ELSE 0 END) AS INT)"),
        ("ph", d.each("e", lambda x, i: f"CASE WHEN {x} THEN md5(concat(key, 'p', {i})) END")),
    ]
    taken = lambda i: f"coalesce({d.get('ph', i)} <= least_hash, false)"
    if noise_type == "char_transpose":
        # pairs in random order, each taken unless a neighbour was, until enough are
        order = d.each(d.sort(d.keep(d.each("ph", lambda h, i: f"({h} || CAST({i} AS STRING))"), lambda x: f"{x} IS NOT NULL")), lambda x, i: f"substr({x}, 33)")
        near = lambda acc, x, k: f"(instr({acc}, concat(',', CAST({x} AS INT) + ({k}), ',')) > 0)"
        n_in = lambda acc: f"(length({acc}) - length(replace({acc}, ',', '')) - 1)"
        steps += [
            ("ord", order),
            ("picked", d.fold("ord", "','", lambda acc, x: f"CASE WHEN {n_in(acc)} < n_requested AND NOT {near(acc, x, -1)} AND NOT {near(acc, x, 1)} THEN concat({acc}, {x}, ',') ELSE {acc} END")),
        ]
        in_ = lambda i: f"(instr(picked, concat(',', {i}, ',')) > 0)"
        out = d.each("units", lambda c, i: f"CASE WHEN {in_(i)} THEN {d.get('units', f'{i}+1')} WHEN {in_(f'({i}-1)')} THEN {d.get('units', f'{i}-1')} ELSE {c} END")
        return steps + [("rewritten", out), ("n_applied", f"CAST({n_in('picked')} AS INT)"), ("submodes", "concat('transpose=', n_applied)"), *_end(d)]
    steps.append(("least_hash", d.get(d.sort(d.keep("ph", lambda h: f"{h} IS NOT NULL")), "n_requested-1")))
    applied, sub = "n_requested", None
    if noise_type == "char_insert":
        pool = d.array(maps.INSERTABLE)
        new = lambda i: d.get(pool, f"floor({_draw(d, 'c', i)} * {len(maps.INSERTABLE)})")
        out = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN concat({c}, {new(i)}) ELSE {c} END")
        sub = "concat('insert=', n_applied)"
    elif noise_type == "char_delete":
        # a token all of whose clusters were taken keeps the one taken last
        n = d.size("units")
        idx = d.each("solid", lambda x, i: i)
        s = lambda i: f"coalesce({d.get('solid', i)}, false)"
        starts = d.keep(idx, lambda i: f"({s(i)} AND NOT {s(f'{i}-1')})")
        ends = d.keep(idx, lambda i: f"({s(i)} AND NOT {s(f'{i}+1')})")
        hashes = lambda a, b: d.cut("ph", a, f"{b}-{a}+1")
        whole = lambda a, b: f"({b} > {a} AND {d.size(d.keep(hashes(a, b), lambda h: f'({h} IS NULL OR {h} > least_hash)'))} = 0)"
        steps += [
            ("starts", starts),
            ("ends", ends),
            ("kept", d.keep(d.zip("starts", "ends", lambda a, b: f"CASE WHEN n_requested > 0 AND {whole(a, b)} THEN {d.most(hashes(a, b))} END"), lambda h: f"{h} IS NOT NULL")),
            ("gone", d.each("units", lambda c, i: f"({taken(i)} AND NOT {d.has('kept', d.get('ph', i))})")),
        ]
        del n
        out = d.each("units", lambda c, i: f"CASE WHEN {d.get('gone', i)} THEN '' ELSE {c} END")
        applied = d.size(d.keep("gone", lambda x: x))
        sub = "concat('delete=', n_applied)"
    elif noise_type == "char_substitute":
        swap = lambda c, i: f"concat({_exchange(d, N3_POOLS, i, d.get('num', i))}, substr({c}, length({_base(d, c)}) + 1))"
        out = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN {swap(c, i)} ELSE {c} END")
        sub = "concat('substitute=', n_applied)"
    elif noise_type == "homophone_confuse":
        out = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN {_exchange(d, maps.HOMOPHONES, i, d.get('num', i))} ELSE {c} END")
        sub = _per_mode(d, {"/".join(m): f"{d.get('num', '{i}')} BETWEEN {lo} AND {lo + len(m) - 1}" for m, lo in zip(maps.HOMOPHONES, _starts(maps.HOMOPHONES), strict=True)}, taken)
    elif noise_type == "matra_perturb":
        alter = "CASE {c} " + " ".join(f"WHEN {d.lit(a)} THEN {d.lit(b)}" for a, b in maps.ALTER.items()) + " END"
        pair = "[" + "".join(maps.ALTER) + "]"
        altered = lambda c, i: f"({d.like(c, pair)} AND {_draw(d, 'c', i)} < {d.double(0.5)})"
        out = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN CASE WHEN {altered(c, i)} THEN {alter.format(c=c)} ELSE '' END ELSE {c} END")
        unit = d.get("units", "{i}")
        sub = _per_mode(d, {"alter": altered(unit, "{i}"), "drop_hasanta": f"{unit} = {d.lit(maps.HASANTA)}", "drop_chandrabindu": f"{unit} = {d.lit(maps.CHANDRABINDU)}", "drop_matra": f"({d.like(unit, '[' + ''.join(maps.MATRAS) + ']')} AND NOT {altered(unit, '{i}')})"}, taken)
    elif noise_type == "conjunct_split":
        out = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN replace({c}, {d.lit(maps.HASANTA)}, '') ELSE {c} END")
        sub = "concat('drop_hasanta=', n_applied)"
    elif noise_type == "elongate":
        mapped, vowel, any_ = ("[" + "".join(x) + "]" for x in (maps.MATRA_VOWEL, maps.VOWELS, maps.MATRAS + maps.VOWELS))
        has = lambda c: f"CASE WHEN {d.like(c, mapped)} THEN 1 ELSE 0 END"
        alone = lambda c: f"CASE WHEN {d.like(c, f'^{vowel}$')} THEN 1 ELSE 0 END"
        pick = lambda c, i: f"floor({_draw(d, 'c', i)} * ({has(c)} + {alone(c)} + 1))"
        mode = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN CASE WHEN {has(c)} = 1 AND {pick(c, i)} = 0 THEN 'insert_vowel' WHEN {alone(c)} = 1 AND {pick(c, i)} = {has(c)} THEN 'repeat_vowel' ELSE 'repeat_final' END END")
        steps.append(("mode", mode))
        vowel_of = lambda c: "CASE " + d.group(c, mapped, 0) + " " + " ".join(f"WHEN {d.lit(a)} THEN {d.lit(b)}" for a, b in maps.MATRA_VOWEL.items()) + " END"
        p1, p2 = f"(?s)^([^{mapped[1:-1]}]*{mapped})(.*)$", f"(?s)^(.*)({any_})([^{any_[1:-1]}]*)$"
        times = lambda i: f"CAST(2 + floor({_draw(d, 'r', i)} * 3) AS INT)"
        m = lambda i: d.get("mode", i)
        out = d.each(
            "units",
            lambda c, i: f"CASE {m(i)} WHEN 'insert_vowel' THEN concat({d.group(c, p1, 1)}, {vowel_of(c)}, {d.group(c, p1, 2)}) WHEN 'repeat_vowel' THEN repeat({c}, {times(i)}) "
            f"WHEN 'repeat_final' THEN concat({d.group(c, p2, 1)}, repeat({d.group(c, p2, 2)}, {times(i)}), {d.group(c, p2, 3)}) ELSE {c} END",
        )
        sub = _per_mode(d, {x: f"{d.get('mode', '{i}')} = '{x}'" for x in ("insert_vowel", "repeat_vowel", "repeat_final")}, taken)
    else:
        out = d.each("units", lambda c, i: f"CASE WHEN {taken(i)} THEN CASE WHEN {d.get('solid', i)} THEN concat({c}, ' ') ELSE '' END ELSE {c} END")
        sub = _per_mode(d, {"split": d.get("solid", "{i}"), "merge": f"NOT {d.get('solid', '{i}')}"}, taken)
    return steps + [("rewritten", out), ("n_applied", f"CAST({applied} AS INT)"), ("submodes", sub), *_end(d)]


def _starts(pools: list[list[str]]) -> list[int]:
    return [sum(len(p) for p in pools[:k]) for k in range(len(pools))]


def _per_mode(d: Spark, modes: dict[str, str], taken) -> str:
    """name=count of every mode, joined by ';'; conditions name the unit's index {i}."""
    counted = [f"'{name}=', {d.size(d.keep(d.each('units', lambda c, i, x=cond: f'({taken(i)} AND ' + x.replace('{i}', i) + ')'), lambda b: b))}" for name, cond in modes.items()]
    return "concat(" + ", ';', ".join(counted) + ")"


def _end(d: Spark) -> Steps:
    return [("noised", d.nfc_bengali(d.join("rewritten"))), ("unchanged", "(noised = t)")]


STATS = ["n_eligible", "n_requested", "n_applied", "submodes", "unchanged"]


def grid_sql(severities: list[int], seeds: list[int]) -> str:
    """A small table severity, frac, seed in SQL of both engines."""
    rows = [f"SELECT {s} AS severity, CAST({fraction(s)!r} AS DOUBLE) AS frac, {k} AS seed" for s in severities for k in seeds]
    return " UNION ALL ".join(rows)


#: Bytes of input that may be shuffled whole so that all cores have a share
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input is too small to be split among them; larger inputs stay as they are.

    Decided by the plan's own size, so nothing runs for it; streams and plans without a size stay as they are."""
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < min(cores * split, SMALL) else df


def eligible_units(df: DataFrame, noise_type: str, text: str = "text") -> DataFrame:
    """The rows with t, units and eligibility, once for all severities and seeds."""
    return staged(spread(df).withColumn("t", nfc(F.col(text))), unit_steps(SPARK, noise_type))


def perturb(df: DataFrame, noise_type: str, severities: list[int], seeds: list[int], text: str = "text") -> DataFrame:
    """A row for every input row, severity and seed: its columns, severity, seed, noised and the statistics."""
    _check_type(noise_type)
    grid = df.sparkSession.sql(grid_sql(severities, seeds))  # at most five severities by the seeds
    # the caller's columns stay in a struct, so that no step's name clashes with them
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("text"))
    out = staged(eligible_units(own, noise_type).crossJoin(F.broadcast(grid)), rewrite_steps(SPARK, noise_type))
    return out.select("row.*", F.lit(noise_type).alias("noise_type"), "severity", "seed", "t", "noised", *STATS)


def emoji_steps(d: Spark, mode: str) -> Steps:
    """N10 from t: noised and n_applied of the mode keep, remove or replace_with_text."""
    if mode not in ("keep", "remove", "replace_with_text"):
        raise ValueError(f"unknown emoji mode {mode!r}")
    count = ("n_eligible", d.occurrences("t", f"[{maps.EMOJI}]"))
    if mode == "keep":
        return [count, ("n_applied", "0"), ("noised", "t")]
    glue = "".join(rf"\x{{{ord(c):x}}}" for c in maps.EMOJI_GLUE)
    if mode == "remove":
        out = d.sub(d.sub(d.sub("t", f"[{maps.EMOJI}{glue}]", ""), f"[{maps.WS}]+", " "), "^ +| +$", "")
    else:
        bare = d.sub("t", f"[{glue}]", "")
        parts = d.find_all(bare, rf"(?s)[{maps.EMOJI}]|[^{maps.EMOJI}]+")
        out = d.join(d.each(parts, lambda p, i: f"CASE WHEN {d.like(p, f'^[{maps.EMOJI}]')} THEN {_labels(d, p)} ELSE {p} END"))
    return [count, ("n_applied", "n_eligible"), ("noised", d.nfc_bengali(out))]


def _labels(d: Spark, p: str) -> str:
    """Label of an emoji by a literal map over all code points of the ranges."""
    cps = [chr(c) for a, b in maps.EMOJI_RANGES for c in range(a, b + 1)]
    return d.get(d.array([maps.emoji_label(c) for c in cps]), d.index(d.array(cps), p))


def emoji_transform(df: DataFrame, mode: str, text: str = "text") -> DataFrame:
    """The rows with N10 applied: t, n_eligible, n_applied, noised."""
    steps = emoji_steps(SPARK, mode)
    out = df.withColumn("t", nfc(F.col(text))).withColumn("r", F.expr(bound(steps, [n for n, _ in steps])))
    return out.select(*df.columns, "t", "r.*")
