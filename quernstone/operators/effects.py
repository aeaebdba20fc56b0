"""Effects of units, inferred from what they call, hold, return, raise and change, by tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (action, resource, ends, names, holds, needs, target). A lower-case call falls under a rule if it ends in one
#: of `ends`, is one of `names` or holds one of `holds`, and holds one of `needs`, if any; without target, the call is its target.
CALL_RULES: list[tuple[str, str, list[str], list[str], list[str], list[str], str | None]] = [
    ("write", "file", [".write_text"], ["write", "writelines"], [], [], None),
    ("read", "file", [".read_text"], ["read", "readlines"], [], [], None),
    ("delete", "file", [".unlink", ".remove", ".rmtree"], [], [], [], None),
    ("create", "directory", [".mkdir", ".makedirs"], [], [], [], None),
    ("move", "file", [".rename", ".move"], ["os.replace", "pathlib.path.replace"], [], [], None),
    ("access", "file", [], ["open", "path.open"], [], [], None),
    ("serialize", "json", [], ["json.dump", "json.dumps"], [], [], "json"),
    ("parse", "json", [], ["json.load", "json.loads"], [], [], "json"),
    ("serialize", "yaml", [], ["yaml.dump", "yaml.safe_dump"], [], [], "yaml"),
    ("parse", "yaml", [], ["yaml.load", "yaml.safe_load"], [], [], "yaml"),
    ("commit", "database", [".commit"], [], [], [], None),
    ("rollback", "database", [".rollback"], [], [], [], None),
    ("insert", "database", [".add", ".bulk_save_objects"], [], [], ["session", "query", "db", "database", "repository"], None),
    ("delete", "database", [".delete"], [], [], ["session", "query", "db", "database"], None),
    ("read", "database", [".query", ".filter", ".select"], [], [], [], None),
    ("send", "http_api", [".request"], [], [], [], None),
    ("publish", "message_queue", [".publish", ".send", ".put"], [], [], ["queue", "kafka", "sqs", "producer", "broker"], None),
    ("consume", "message_queue", [".consume", ".receive", ".get"], [], [], ["queue", "kafka", "sqs", "consumer", "broker"], None),
    ("execute", "process", [], ["subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.popen"], [], [], None),
    ("click", "browser_page", [".click"], [], [], [], None),
    ("write", "browser_page", [".send_keys", ".fill", ".type"], [], [], [], None),
    ("navigate", "browser_page", [".goto"], [], [], [], None),
    ("navigate", "browser_page", [".get"], [], [], ["driver"], None),
    ("render", "terminal", [], ["print"], [], [], None),
    ("read", "terminal", [], ["input"], [], [], None),
    ("render", "ui", [], [], ["render", "display"], [], None),
    ("write", "gpio_pin", [], [], ["gpio", "digitalwrite", "analogwrite", "pinmode"], [], None),
    ("train", "model", [".fit", ".fit_transform", ".train"], [], [], [], None),
    ("predict", "model", [".predict", ".infer"], [], [], [], None),
    ("transform", "dataset", [".transform"], [], [], [], None),
    ("evaluate", "model", [".score", ".evaluate"], [], [], [], None),
    ("emit", "log", [".debug", ".info", ".warning", ".error", ".exception", ".critical"], [], [], [], None),
    ("emit", "metric", [".increment", ".gauge"], [], ["metric"], [], None),
]
#: Fixed values: (markers, ((action, resource, ends) ...), action and resource of other calls with a marker).
FAMILIES: list[tuple[list[str], list[tuple[str, str, list[str]]], tuple[str, str]]] = [
    (["redis", "cache"], [("read", "cache", [".get"]), ("write", "cache", [".set", ".put", ".add"]), ("delete", "cache", [".delete", ".invalidate", ".clear"])], ("access", "cache")),
    (["docker", "container"], [("start", "container", [".start"]), ("stop", "container", [".stop"]), ("create", "container", [".build"]), ("execute", "container", [".run"]), ("delete", "container", [".remove"])], ("access", "container")),
    (["serial"], [("read", "serial_port", [".read"]), ("write", "serial_port", [".write"])], ("access", "serial_port")),
    (["stream.write", "audio", "sound", "midi", "play"], [("play", "audio_stream", [".write", ".send"]), ("record", "audio_stream", [".read", ".record"]), ("play", "audio_stream", [".play"]), ("stop", "audio_stream", [".stop"])], ("access", "audio_stream")),
]
#: Methods and clients of HTTP calls; SQL verbs and what their effect is; calls that are known to do nothing outside, and parts of calls that rules know.
HTTP_METHODS, HTTP_CLIENTS = [".get", ".post", ".put", ".delete", ".patch"], ["requests", "httpx", "aiohttp", "http_client", "api_client"]
SQL_VERBS = {"insert": "insert", "update": "update", "delete": "delete", "select": "read"}
HARMLESS = ["append", "get", "items", "join", "lower", "pop", "replace", "setdefault", "split", "strip", "upper", "values"]
CLASSIFIED = [
    "audio", "cache", "click", "commit", "container", "docker", "dump", "execute", "fit", "gpio", "http", "json", "load", "logger", "metric", "open", "predict",
    "read_text", "redis", "request", "run", "safe_dump", "safe_load", "send_keys", "serial", "subprocess", "write_text", "yaml",
]
_EFFECT = "struct<action:string,resource:string,target:string,output:string,confidence:string>"


def _effect(action: Column | str, resource: str, target: Column | None, output: Column | None = None, confidence: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    target = none if target is None else target
    sure = F.lit(confidence) if confidence else F.when(F.coalesce(target, F.lit("")) != "", "high").otherwise("medium")
    return F.struct(F.lit(action) if isinstance(action, str) else action, F.lit(resource), target, none if output is None else output, sure).cast(_EFFECT)


def _ends(c: Column, ends: list[str]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | c.endswith(e)
    return out


def _holds(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def sql_effect(text: Column) -> Column:
    """The effect of one SQL statement: its verb, and the table named after into, from or update."""
    plain = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    words = F.split(F.trim(F.regexp_replace(plain, "[, ]+", " ")), " ")
    after = [F.when(F.array_contains(words, w), F.get(words, F.array_position(words, w).cast("int"))) for w in ("into", "from", "update")]
    action = F.coalesce(*[F.when(plain.startswith(v), a) for v, a in SQL_VERBS.items()], F.lit("access"))
    return _effect(action, "database", F.coalesce(*after))


def _is_sql(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(r"^(insert|update|delete|select) ")


def call_effects(call: Column, strings: Column) -> Column:
    """All effects that one call implies."""
    low = F.lower(call)
    out = []
    for action, resource, ends, names, holds, needs, target in CALL_RULES:
        met = _ends(low, ends) | low.isin(names) if names else _ends(low, ends)
        met = (met | _holds(low, holds)) & (_holds(low, needs) if needs else F.lit(True))
        out.append(F.when(met, _effect(action, resource, F.lit(target) if target else call)))
    sql = F.get(F.filter(strings, _is_sql), 0)
    out.append(F.when(_ends(low, [".execute", ".executemany"]), F.when(sql.isNotNull(), sql_effect(sql)).otherwise(_effect("access", "database", call))))
    method = F.substring_index(low, ".", -1)
    out.append(F.when(_ends(low, HTTP_METHODS) & _holds(low, HTTP_CLIENTS), _effect("send", "http_api", method)))
    for markers, rules, other in FAMILIES:
        kinds = [F.when(_ends(low, ends), _effect(a, r, call)) for a, r, ends in rules]
        if other[1] == "audio_stream":
            kinds.append(F.when(low.contains("midi"), _effect("send", "midi_event", call)))
        out.append(F.when(_holds(low, markers), F.coalesce(*kinds, _effect(*other, call))))
    out.append(F.when(low.contains("pandas") | low.startswith("pd.") | low.startswith("dataframe."), _effect("transform", "dataset", call)))
    code = F.get(F.filter(strings, lambda s: (s == F.upper(s)) & s.contains("_") & (F.length(s) > 4) & s.rlike("[A-Z]")), 0)
    out.append(F.when(low.endswith("findings.append"), _effect("emit", "finding", F.coalesce(code, F.lit("finding")))))
    return F.array_compact(F.array(*out))


def infer_effects(units: DataFrame, unit: str) -> DataFrame:
    """(unit, ord, action, resource, target, output, confidence) from the lists calls, strings, returns, raises, mutations of each unit; of equal effects, the first."""
    empty = F.array().cast("array<string>")
    calls, strings, returns, raises, mutations = (F.coalesce(F.col(c), empty) for c in ("calls", "strings", "returns", "raises", "mutations"))
    effects = F.concat(
        F.flatten(F.transform(calls, lambda c: call_effects(c, strings))),
        F.transform(F.filter(strings, _is_sql), sql_effect),
        F.transform(returns, lambda r: _effect("return", "value", F.substring(F.sha2(r, 256), 1, 12), r, "medium")),
        F.transform(raises, lambda r: _effect("raise", "exception", r, None, "high")),
        F.transform(F.filter(mutations, lambda m: m.startswith("self.")), lambda m: _effect("update", "memory_state", m)),
    )
    rows = units.select(unit, F.posexplode(effects).alias("ord", "e")).select(unit, "ord", "e.*")
    same = [unit, "action", "resource", "target", "output"]
    return rows.groupBy(*same).agg(F.min("ord").alias("ord"), F.min_by("confidence", "ord").alias("confidence"))


def unclassified_calls(calls: Column, builtins: list[str]) -> Column:
    """Sorted names of calls that look as if they reach outside and that no rule knows."""
    def unknown(c: Column) -> Column:
        low = F.lower(c)
        return ~c.isin(builtins) & ~_ends(low, [f".{h}" for h in HARMLESS]) & ~_holds(low, CLASSIFIED) & c.contains(".") & ~low.startswith("self.") & ~low.startswith("cls.")

    return F.array_sort(F.array_distinct(F.filter(calls, unknown)))
