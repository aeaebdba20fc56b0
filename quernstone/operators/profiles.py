"""Duplicate profiles of units: signals of ten domains, a cascade of keys, inherited keys, findings and cache checks.

A unit is one row of evidence (see EVIDENCE); lists are arrays in the order in
which the unit shows them. Detectors are functions from evidence to an array of
signals, so that others can be added to DETECTORS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = {
    "kind": "string", "symbol": "string", "constants": "array<string>", "decorators": "array<string>", "imports": "array<string>", "calls": "array<string>", "resolved": "array<string>",
    "mutations": "array<string>", "reads": "array<string>", "writes": "array<string>", "provenance": "array<string>", "interface": "string", "action": "string", "resource": "string",
    "target": "string", "output": "string", "outcome_key": "string", "return_hash": "string", "body_hash": "string", "wrapper": "boolean", "wrapper_target": "string",
    "child_keys": "array<string>", "child_strengths": "array<string>",
}
#: Kinds of functions; actions that mark an outcome; targets that say nothing; what a file's methods are called.
FUNCTIONS = ["function", "method", "nested_function"]
STRONG_ACTIONS = [
    "authorize", "click", "commit", "compile", "configure", "connect", "consume", "create", "delete", "deploy", "emit", "execute", "flash", "insert", "move",
    "play", "predict", "publish", "receive", "record", "render", "send", "start", "stop", "train", "transform", "update", "write",
]
GENERIC = ["", "*", "unknown", "value", "result", "data", "item", "items", "self", "cls", "database", "process", "device", "message"]
FILE_METHODS = [".write_text", ".write", ".writelines", ".read_text", ".read", ".readlines", ".mkdir", ".unlink", ".remove", ".rmtree", ".rename", ".replace"]
#: Actions too weak for a hard signal, effects that are not compared, starters of programs, and what a target may lack.
WEAK_SIGNALS = ["return", "access", "parse", "serialize", "read", "query", "render"]
NOT_COMPARED, NOT_COMPARED_RESOURCES = ["access", "parse", "read", "serialize"], ["memory_state", "terminal", "ui", "value"]
STARTERS, TARGETLESS = ["run", "call", "check_call", "check_output", "Popen", "system", "popen"], ["execute", "render", "train", "predict"]
#: Markers of the detectors.
ROUTES = ["get", "post", "put", "patch", "delete", "route"]
DATABASES, DEVICES, GAMES = ["sqlalchemy", "sqlite", "psycopg", "django.db"], ["gpio", "serial", "smbus", "machine"], ["pygame", "arcade", "pyglet"]
COMMANDS, GAME_STATE = ["git", "docker", "podman", "python", "pytest", "bash", "sh"], ["position", "rect", "health", "velocity", "score"]
SENDERS, EVENT_WORDS, NO_EVENTS = ["publish", "send", "emit", "enqueue"], ["created", "updated", "deleted", "event", "queue", "message"], ["created_at", "updated_at", "deleted_at"]
STATE_WORDS = ["status", "state", "ready", "enabled", "current"]

_SIGNAL = "array<struct<action:string,resource:string,target:string,confidence:string,evidence:string>>"


def signal(action: Column | str, resource: str, target: Column, confidence: Column | str, evidence: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(*[lit(v).alias(n) for n, v in (("action", action), ("resource", resource), ("target", target), ("confidence", confidence), ("evidence", evidence))])


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _one(condition: Column, what: Column) -> Column:
    """An array of what, or an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(what).cast(_SIGNAL)).otherwise(F.array().cast(_SIGNAL))


def _any(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _first(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(values, test), 0)


def _has(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def looks_like_path(c: Column) -> Column:
    slashed = F.length(F.regexp_replace(c, r"^[/\\]+|[/\\]+$", "")) > 2
    return ~c.isin("/", "\\") & ~c.startswith(".") & F.when(c.rlike(r"[/\\]"), slashed).otherwise(c.rlike(r"^[A-Za-z0-9_-]+\.(yaml|yml|json|txt|py|db)$"))


def looks_like_sql(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return low.rlike(r"^(select|insert|update|delete|create table|drop|alter)\s+\S+") | low.rlike(r"\bselect\b.+\bfrom\b")


def _sql_target() -> Column:
    return F.substring(_first(_list("constants"), looks_like_sql), 1, 80)


def filesystem() -> Column:
    action = F.coalesce(F.col("action"), F.lit("access"))
    high = action.isin(STRONG_ACTIONS) & F.coalesce(F.col("resource").isin("file", "directory"), F.lit(False)) & (action != "render")
    confidence = F.when(high, "high").otherwise("medium")
    return F.transform(F.filter(_list("constants"), looks_like_path), lambda c: signal(action, "file", c, confidence, F.concat(F.lit("path constant "), c))).cast(_SIGNAL)


def web() -> Column:
    endpoint = _first(_list("constants"), lambda c: c.startswith("/"))

    def method(x: Column) -> Column:
        low = F.lower(x)
        return F.coalesce(*[F.when(low.endswith(f".{m}") | (low == m), m.upper()) for m in ROUTES])

    routed = F.filter(_list("decorators"), lambda x: method(x).isNotNull())
    routes = F.transform(routed, lambda x: signal("route", "http_endpoint", F.concat_ws(":", method(x), F.coalesce(endpoint, x)), "high", F.concat(F.lit("decorator "), x)))
    paths = F.filter(_list("constants"), lambda c: c.startswith("/") & (F.length(c) > 1))
    return F.concat(routes.cast(_SIGNAL), F.transform(paths, lambda c: signal("route", "http_endpoint", c, "medium", F.concat(F.lit("endpoint constant "), c))).cast(_SIGNAL))


def database() -> Column:
    sql, used = _sql_target(), F.lower(F.concat_ws("|", _list("imports")))
    high = sql.isNotNull() & F.coalesce(F.col("resource") == "database", F.lit(False))
    imported = signal(F.coalesce(F.col("action"), F.lit("query")), "database", F.coalesce(sql, F.col("target"), F.lit("database")), F.when(high, "high").otherwise("medium"), "database import/call")
    action = F.when(F.lower(F.ltrim(sql)).startswith("select "), "query").otherwise("execute")
    return F.concat(_one(_has(used, DATABASES), imported), _one(sql.isNotNull(), signal(action, "database", sql, "high", "SQL constant")))


def dataframe() -> Column:
    def column(m: Column) -> Column:
        quoted = F.nullif(F.regexp_extract(m, r"\[['\"]([^'\"]+)['\"]\]", 1), F.lit(""))
        return F.coalesce(quoted, F.when(m.contains("."), F.substring_index(m, ".", -1)))

    named = F.filter(_list("mutations"), lambda m: column(m).isNotNull())
    found = F.transform(named, lambda m: signal("mutate", "dataframe_column", column(m), "high", F.concat(F.lit("dataframe mutation "), m))).cast(_SIGNAL)
    return F.when(_any(_list("imports"), lambda i: i.startswith("pandas")), found).otherwise(F.array().cast(_SIGNAL))


def automation() -> Column:
    runs = F.lower(F.concat_ws("|", _list("calls"))).contains("subprocess") | F.array_contains(_list("imports"), "subprocess")
    program = F.coalesce(_first(_list("constants"), lambda c: c.isin(COMMANDS)), F.lit("process"))
    return _one(runs, signal("execute", "process", program, "medium", "shared process executable"))


def embedded() -> Column:
    def is_device(i: Column) -> Column:
        return F.substring_index(i, ".", 1).isin(DEVICES)

    device = _first(_list("constants"), lambda c: c.rlike(r"(?i)^(COM\d+|GPIO\d+|pin_?\d+|/dev/\w+)"))
    return _one(_any(_list("imports"), is_device), signal("write", "gpio_pin", F.coalesce(device, F.lit("device")), "high", "embedded import/constant"))


def game() -> Column:
    used = F.lower(F.concat_ws("|", _list("imports")))
    state = F.filter(_list("mutations"), lambda m: _has(F.lower(m), GAME_STATE))
    found = F.transform(state, lambda m: signal("mutate", "game_entity", m, "high", F.concat(F.lit("game mutation "), m))).cast(_SIGNAL)
    return F.when(_has(used, GAMES), found).otherwise(F.array().cast(_SIGNAL))


def cli() -> Column:
    used, marked = F.lower(F.concat_ws("|", _list("imports"))), F.lower(F.concat_ws("|", _list("decorators")))
    return _one(_has(used, ["click", "typer"]) | marked.contains("command"), signal("command", "cli", F.substring_index("symbol", ".", -1), "high", "CLI decorator/import"))


def messaging() -> Column:
    event = _first(_list("constants"), lambda c: ~c.isin(NO_EVENTS) & c.rlike("^[a-z][a-z0-9_]+$") & _has(c, EVENT_WORDS))
    return _one(_has(F.lower(F.concat_ws("|", _list("calls"))), SENDERS), signal("publish", "message_queue", F.coalesce(event, F.lit("message")), "high", "publish/send/emit call"))


def state_machine() -> Column:
    origin = lambda p: F.regexp_extract(p, "^(.*?)<-(.*)$", 2)
    known = F.filter(_list("provenance"), lambda p: p.contains("<-") & (origin(p) != "") & ~origin(p).isin(GENERIC))
    reads = F.transform(known, lambda p: signal("read_state", "object_attribute", F.concat(F.regexp_extract(p, "^(.*?)<-", 1), F.lit("|source:"), origin(p)), "medium", "attribute provenance"))
    changed = F.filter(_list("writes"), lambda w: _has(F.lower(w), STATE_WORDS))
    return F.concat(reads.cast(_SIGNAL), F.transform(changed, lambda w: signal("mutate", "object_state", w, "medium", "state-like attribute write")).cast(_SIGNAL))


#: In the order in which their signals are looked at.
DETECTORS: list[Callable[[], Column]] = [filesystem, web, database, dataframe, automation, embedded, game, cli, messaging, state_machine]


def signals(detectors: list[Callable[[], Column]] | None = None) -> Column:
    """All signals of a unit's evidence."""
    return F.concat(*[make() for make in detectors or DETECTORS])


def is_generic(target: Column) -> Column:
    return target.isNull() | F.lower(F.trim(target)).isin(GENERIC)


def strong_outcome() -> Column:
    """Whether a unit's outcome is enough to tell duplicates by."""
    action, resource, target = (F.coalesce(F.col(c), F.lit("")) for c in ("action", "resource", "target"))
    own_call = _any(_list("calls"), lambda c: F.col("target").eqNullSafe(c) | F.col("target").eqNullSafe(F.substring_index(c, ".", -1)))
    low = F.lower(F.trim(target))
    method = ~looks_like_path(low) & F.exists(F.array(*map(F.lit, FILE_METHODS)), lambda m: low.endswith(m))
    bad = own_call | (action == "render") | (resource == "log") | ((resource == "process") & F.substring_index(target, ".", -1).isin(STARTERS))
    bad = bad | ((resource == "database") & (F.lower(F.ltrim(target)).startswith("select ") | (target.contains(" ") & ~looks_like_sql(target))))
    bad = bad | (resource.isin("file", "directory") & method)
    bad = bad | action.isin(NOT_COMPARED) | ((action == "create") & (resource == "directory")) | resource.isin(NOT_COMPARED_RESOURCES) | target.startswith("self.")
    named = F.when(F.col("target").isNull(), action.isin(TARGETLESS)).otherwise(~is_generic(target))
    return (action != "") & (resource != "") & (F.coalesce(F.col("outcome_key"), F.lit("")) != "") & action.isin(STRONG_ACTIONS) & ~bad & named


def short_hash(c: Column) -> Column:
    """The first 16 hex digits of a text's digest; null for no text."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.substring(F.sha2(c, 256), 1, 16))


def _key(when: Column, key: Column, strength: str, reason: Column | str) -> Column:
    made = F.struct(key.alias("duplicate_key"), short_hash(key).alias("duplicate_hash"), F.lit(strength).alias("strength"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def duplicate_keys(units: DataFrame) -> DataFrame:
    """units with `signals` and `keys`: struct(duplicate_key, duplicate_hash, strength, reason) of the first rule that holds."""
    df = units.withColumn("signals", signals())
    function = F.coalesce(F.col("kind").isin(FUNCTIONS), F.lit(False))
    wrapper, resolved, calls, interface = F.coalesce(F.col("wrapper"), F.lit(False)), _list("resolved"), _list("calls"), F.coalesce(F.col("interface"), F.lit(""))
    children = _list("child_keys")
    df = df.withColumn("_hard", F.get(F.filter("signals", lambda s: (s.confidence == "high") & ~is_generic(s.target) & ~s.action.isin(WEAK_SIGNALS)), 0))
    hard = F.col("_hard")
    star = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("*"))
    strong_children = F.transform(F.filter(F.arrays_zip(children.alias("k"), _list("child_strengths").alias("s")), lambda z: z.s == "strong"), lambda z: z.k)
    df = df.withColumn("_child", F.get(strong_children, 0))
    child = F.col("_child")
    delegates = wrapper | ((F.col("action") == "return") & (F.size(resolved) == 1) & (F.size(calls) <= 1))
    target = F.when(F.size(calls) > 0, F.coalesce(F.nullif(F.col("wrapper_target"), F.lit("")), F.get(calls, 0))).otherwise("child")
    part = lambda name, col, n: F.when(F.size(_list(col)) > 0, F.concat(F.lit(f"{name}:"), F.array_join(F.slice(_list(col), 1, n), ",")))
    parts = F.array_compact(F.array(part("calls", "resolved", 3), part("imports", "imports", 4), F.when(interface != "", F.concat(F.lit("interface:"), interface)), part("constants", "constants", 3), part("attrs", "provenance", 3), part("mutations", "mutations", 3)))
    anchor = (F.size(resolved) > 0) | (F.size("signals") > 0) | (F.size(_list("provenance")) > 0)
    returned = F.col("return_hash")
    plain = ((F.size(_list("reads")) > 0) & (F.size(_list("provenance")) == 0)) | returned.rlike("^(none|true|false)")
    rules = [
        _key(function & hard.isNotNull(), F.concat_ws("|", hard.action, hard.resource, hard.target), "strong", F.concat(F.lit("seen: "), hard.evidence)),
        _key(function & strong_outcome(), F.concat_ws("|", "action", "resource", star("target"), star("output")), "strong", "its outcome can be seen directly"),
        _key(function & wrapper & (F.coalesce(F.col("wrapper_target"), F.lit("")) != "") & (F.size(children) == 0), F.concat_ws("|", F.lit("wrapper"), F.lit("call"), "wrapper_target"), "strong", "it wraps one call"),
        _key(child.isNotNull() & delegates, F.concat(F.lit("delegate|"), target, F.lit("|child:"), child), "strong", "it hands on to a child with a strong key"),
        _key(child.isNotNull() & (interface != "") & (F.size(resolved) == 1), F.concat(F.lit("child|"), child, F.lit("|interface:"), interface), "weak", "it calls one child with a strong key behind an interface"),
        _key(child.isNotNull(), F.concat(F.lit("child|"), child), "weak", "it calls a child with a strong key, among others"),
        _key(function & (F.size(parts) >= 3) & anchor, F.concat(F.lit("composite|"), F.array_join(parts, "|")), "weak", "several signals of middling weight agree"),
        _key(returned.isNotNull() & ~F.coalesce(plain, F.lit(False)), F.concat(F.lit("return|"), returned), "weak", "it returns the same expression"),
        _key(F.col("body_hash").isNotNull(), F.concat(F.lit("structure|"), F.col("body_hash")), "weak", "its structure is the same"),
    ]
    nothing = F.struct(*[F.lit(v).cast("string").alias(n) for n, v in (("duplicate_key", None), ("duplicate_hash", None), ("strength", "unknown"), ("reason", "nothing tells it apart"))])
    return df.withColumn("keys", F.coalesce(*rules, nothing)).drop("_hard", "_child")


def inherited_keys(units: DataFrame, unit: str, calls: DataFrame, *, depth: int = 3) -> DataFrame:
    """units with the keys that they inherit from the units they call (unit, child, ord), `depth` levels deep.

    Level by level from the deepest: a unit's children show the keys that they
    have with their own children one level less deep, so that cycles end.
    """
    bare = units.drop("child_keys", "child_strengths")
    empty = F.array().cast("array<string>")
    level = duplicate_keys(bare.withColumn("child_keys", empty).withColumn("child_strengths", empty))
    for _ in range(depth):
        shown = level.select(F.col(unit).alias("_c"), "keys.duplicate_key", "keys.strength").where("duplicate_key is not null")
        met = calls.join(shown, F.col("child") == F.col("_c")).groupBy(F.col(unit).alias("_u"))
        lists = met.agg(F.array_sort(F.collect_list(F.struct("ord", "duplicate_key", "strength"))).alias("_k"))
        joined = bare.join(lists, F.col(unit) == F.col("_u"), "left")
        level = duplicate_keys(joined.withColumn("child_keys", F.coalesce(F.col("_k.duplicate_key"), empty)).withColumn("child_strengths", F.coalesce(F.col("_k.strength"), empty)).drop("_k", "_u"))
    return level


def duplicate_findings(blocks: DataFrame, *, allowed: DataFrame | None = None) -> DataFrame:
    """(duplicate_hash, strength, n, code) of active blocks (id, status, symbol, purpose, duplicate_hash, strength) that share a key.

    Strong keys block, weak ones ask for review. Groups of one method name in
    several classes, groups that are allowed (duplicate_hash) and groups whose
    members are just those of one purpose give none.
    """
    active = blocks.where("status = 'active'")
    keyed = active.where("duplicate_hash is not null and strength in ('strong', 'weak')")
    method, parent = F.substring_index("symbol", ".", -1), F.element_at(F.split("symbol", r"\."), -2)
    dotted = F.col("symbol").contains(".")
    members = [F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members")]
    groups = keyed.groupBy("duplicate_hash", "strength").agg(*members, F.min(dotted).alias("dotted"), F.min(method).alias("m1"), F.max(method).alias("m2"), F.min(F.when(dotted, parent)).alias("p1"), F.max(F.when(dotted, parent)).alias("p2")).where("n > 1")
    groups = groups.where(~(F.col("dotted") & (F.col("m1") == F.col("m2")) & (F.col("p1") != F.col("p2"))))
    same = active.where(F.trim(F.coalesce("purpose", F.lit(""))) != "").groupBy(F.lower(F.trim("purpose")).alias("purpose")).agg(*members).where("n > 1").select(F.col("n").alias("pn"), F.col("members").alias("pm"))
    groups = groups.join(same, (F.col("n") == F.col("pn")) & (F.col("members") == F.col("pm")), "left_anti")
    if allowed is not None:
        groups = groups.join(allowed.select(F.col("duplicate_hash").alias("ah")), F.col("duplicate_hash") == F.col("ah"), "left_anti")
    return groups.select("duplicate_hash", "strength", "n", F.when(F.col("strength") == "strong", "DUPLICATE_ACTIVE_PROFILE").otherwise("DUPLICATE_PROFILE_REVIEW").alias("code"))


def source_fingerprint(parts: list[Column]) -> Column:
    """A unit's own hash, over the hashes of its parts; lists are joined first."""
    return F.coalesce(short_hash(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), F.lit(""))


def dependency_fingerprints(units: DataFrame, unit: str, calls: DataFrame, parts: list[str]) -> DataFrame:
    """(unit, dependency_hash) over the sorted hashes of the units that each calls."""
    shown = units.select(F.col(unit).alias("_c"), F.explode(F.array_compact(F.array(*parts))).alias("part"))
    met = calls.join(shown, F.col("child") == F.col("_c")).groupBy(unit).agg(F.sort_array(F.collect_list("part")).alias("p"))
    return met.select(unit, short_hash(F.array_join("p", "|")).alias("dependency_hash"))


def reusable(cached: DataFrame, current: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """The keys whose whole signature is still what was cached; nothing cached, or a null part that differs, is not."""
    now = current.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in signature])
    same = F.lit(True)
    for c in signature:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return cached.join(now, (F.col(key) == F.col("_k")) & same, "left_semi")
