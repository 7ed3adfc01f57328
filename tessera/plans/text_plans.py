"""Queries over texts, conversations, JSON properties and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.functions import text as X
from tessera.functions.arrays import fixed
from tessera.operators import chat as C
from tessera.operators import targets as TG
from tessera.operators import validate as V
from tessera.session import table


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.conversation_rows(table(spark, sf_dir, "conversations"))
    texts = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(C.first_text(m)).cast("string")))
    return rows.select(
        "conv_id", F.size("messages").alias("n_messages"), F.concat_ws(",", texts).alias("shape"),
        F.md5(F.coalesce(C.first_assistant_text(F.col("messages")), F.lit(""))).alias("first_md5"), F.md5(F.coalesce(C.last_assistant_text(F.col("messages")), F.lit(""))).alias("last_md5"),
    )


CHAT_ROWS = """SELECT conv_id, count(*)::INTEGER AS n_messages, string_agg(role||':'||length(text), ',' ORDER BY turn) AS shape,
md5(coalesce(arg_min(text, turn) FILTER (role='assistant'),'')) AS first_md5, md5(coalesce(arg_max(text, turn) FILTER (role='assistant'),'')) AS last_md5
FROM conversations GROUP BY conv_id"""


def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.conversation_rows(table(spark, sf_dir, "conversations"))
    rows = rows.select("conv_id", C.prompt_of(F.col("messages")).alias("p"), C.completion_of(F.col("messages")).alias("c"))
    roles = lambda c: F.concat_ws(",", F.transform(c, lambda m: m["role"]))
    return rows.select("conv_id", F.size("p").alias("n_prompt"), F.size("c").alias("n_completion"), roles("p").alias("prompt_roles"), roles("c").alias("completion_roles"))


PROMPT_COMPLETION = """WITH m AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT conv_id, n, min(i) FILTER (role='assistant')-1 AS f FROM m GROUP BY conv_id, n),
s AS (SELECT conv_id, n, CASE WHEN f IS NULL THEN greatest(n-1,1) WHEN f<=0 THEN 1 ELSE f END AS at_ FROM a)
SELECT conv_id, least(at_,n)::INTEGER AS n_prompt, greatest(n-at_,1)::INTEGER AS n_completion, string_agg(role,',' ORDER BY i) FILTER (i<=at_) AS prompt_roles,
 string_agg(role,',' ORDER BY i) FILTER (i>at_ OR (n<=at_ AND i=n)) AS completion_roles FROM s JOIN m USING (conv_id, n) GROUP BY conv_id, n, at_"""


def placeholder_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
    rows = docs.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), "text"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"),
        F.round(F.avg(V.has_any(F.col("text"), V.PLACEHOLDERS).cast("int")), 6).alias("placeholder_rate"),
        F.round(F.avg(V.has_any(F.col("text"), (*V.BANNED, "|", "%%%")).cast("int")), 6).alias("banned_rate"),
    )


def _sql_any(tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in tokens) + ")"


PLACEHOLDER_RATE = f"""SELECT source, count(*) AS n, round(avg({_sql_any(V.PLACEHOLDERS)}::INT),6) AS placeholder_rate, round(avg({_sql_any((*V.BANNED, "|", "%%%"))}::INT),6) AS banned_rate
FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY source"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"), "props")
    keyed = F.format_string('"1,%spx"', F.lpad(F.col("raw"), 3, "0"))
    return rows.select("event_id", jsonx.lenient_number(F.col("raw")).alias("k"), jsonx.lenient_number(keyed).alias("lenient"), F.concat_ws(",", F.array_sort(F.json_object_keys("props"))).alias("keys"))


JSON_PROPS = """SELECT event_id, (props::JSON->>'$.k')::DOUBLE AS k, 1000.0::DOUBLE+(props::JSON->>'$.k')::DOUBLE AS lenient, array_to_string(list_sort(json_keys(props)),',') AS keys FROM events"""

TASK, KEY = "seat_contact_bounding_box", "seat_contact_box"


def _noisy() -> Column:
    """Props wrapped as model answers are: plain, fenced, in prose, quoted wrongly, cut off."""
    k = F.get_json_object("props", "$.k")
    sides = F.concat(F.lit('{"x_min": '), k, F.lit(', "y_min": "12px", "x_max": '), (k.cast("int") + 40).cast("string"), F.lit(', "y_max": 90.5}'))
    full = F.concat(F.lit(f'{{"task": "{TASK}", "image_size": {{"width": 224, "height": "224"}}, "{KEY}": '), sides, F.lit("}"))
    kind = F.col("event_id") % 6
    return (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Sure: {a} "), full, F.lit(" as asked {} ."), F.col("props")))
        .when(kind == 3, F.replace(full, F.lit('"'), F.lit("'")))
        .when(kind == 4, F.substring(full, 1, 60))
        .otherwise(F.col("props"))
    )


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", jsonx.recovered(_noisy(), TASK, KEY).alias("r"))
    return rows.select("event_id", "r.valid_json", "r.schema_valid", F.concat_ws("|", F.transform("r.box", lambda v: F.round(v, 2).cast("string"))).alias("box"), "r.last")


SQL_FULL = f"""'{{"image_size":{{"height":"224","width":224}},"{KEY}":{{"x_max":'||(k+40)||',"x_min":'||k||',"y_max":90.5,"y_min":"12px"}},"task":"{TASK}"}}'"""
JSON_RECOVER = f"""WITH e AS (SELECT event_id, event_id%6 AS kind, props, (props::JSON->>'$.k')::INTEGER AS k FROM events)
SELECT event_id, kind IN (0,1,2,5) AS valid_json, kind IN (0,1,2) AS schema_valid,
       CASE WHEN kind IN (0,1,2) THEN k||'.0|12.0|'||(k+40)||'.0|90.5' ELSE '' END AS box,
       CASE WHEN kind IN (0,1) THEN {SQL_FULL} WHEN kind IN (2,5) THEN '{{"k":'||k||'}}' END AS last FROM e"""


def stage_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recorded attempts of runs of four, at most three of which are made: some calls fail, some answers hold no object or a wrong one."""
    rows = table(spark, sf_dir, "events").select("event_id", "props", jsonx.recovered(_noisy(), TASK, KEY).alias("r"), _noisy().alias("raw"))
    errors = F.when(F.col("r.schema_valid"), F.array().cast("array<string>")).otherwise(F.array(F.lit("not of the schema"), F.concat(F.lit("keys: "), F.concat_ws(",", F.json_object_keys("r.last")))))
    rows = rows.select(
        F.floor(F.col("event_id") / 4).alias("run"), (F.col("event_id") % 4 + 1).cast("int").alias("attempt"), F.when(F.col("event_id") % 11 == 0, "timeout").alias("api_error"),
        "raw", F.when(F.col("r.valid_json"), F.col("r.last")).alias("parsed"), errors.alias("errors"),
    )
    runs = C.staged_retries(rows, 3, "Answer in JSON.", "stage A", 20)
    return runs.select("run", "ok", "attempts", F.md5("data").alias("data_md5"), F.concat_ws("|", "errors").alias("errors"), F.md5(F.concat_ws("|", "prompts")).alias("prompts_md5"), F.md5("last_parsed").alias("last_md5"))


SQL_RAW = f"""CASE kind WHEN 3 THEN replace(f,'"',chr(39)) ELSE left(f,60) END"""
STAGE_RETRY = f"""WITH e AS (SELECT event_id, event_id//4 AS run, event_id%4+1 AS attempt, event_id%6 AS kind, props, (props::JSON->>'$.k')::INTEGER AS k, event_id%11=0 AS api FROM events WHERE event_id%4<3),
j AS (SELECT *, CASE WHEN kind IN (0,1) THEN {SQL_FULL} WHEN kind IN (2,5) THEN '{{"k":'||k||'}}' END AS parsed,
  '{{"task": "{TASK}", "image_size": {{"width": 224, "height": "224"}}, "{KEY}": {{"x_min": '||k||', "y_min": "12px", "x_max": '||(k+40)||', "y_max": 90.5}}}}' AS f FROM e),
m AS (SELECT *, 'stage A attempt '||attempt AS name, CASE WHEN kind=5 THEN 'not of the schema; keys: k' END AS bad FROM j),
t AS (SELECT *, CASE WHEN api THEN name||': API error: timeout' WHEN parsed IS NULL THEN name||': JSON parse failed; raw_preview='||left(replace({SQL_RAW},chr(10),' '),20) WHEN bad IS NOT NULL THEN name||': validation failed: '||bad END AS message FROM m),
c AS (SELECT *, CASE WHEN NOT api AND parsed IS NOT NULL THEN bad ELSE message END AS carried, min(CASE WHEN message IS NULL THEN attempt END) OVER (PARTITION BY run) AS stop FROM t),
u AS (SELECT *, 'Answer in JSON.'||coalesce(chr(10)||chr(10)||'Previous output issues:'||chr(10)||lag(carried) OVER (PARTITION BY run ORDER BY attempt)||chr(10)||'Return ONLY valid JSON object.','') AS prompt FROM c WHERE stop IS NULL OR attempt<=stop)
SELECT run, any_value(stop) IS NOT NULL AS ok, coalesce(any_value(stop),3)::INTEGER AS attempts, md5(max(CASE WHEN attempt=stop THEN parsed END)) AS data_md5, coalesce(string_agg(message,'|' ORDER BY attempt),'') AS errors,
 md5(string_agg(prompt,'|' ORDER BY attempt)) AS prompts_md5, md5(arg_max(parsed, attempt) FILTER (parsed IS NOT NULL)) AS last_md5 FROM u GROUP BY run"""


def file_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of files by type: each is a target whose box lies in a frame of 100 pixels."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "props")
    box = F.struct(*[v.cast("double").alias(n) for n, v in (("x_min", F.col("k")), ("y_min", F.lit(5)), ("x_max", F.col("value")), ("y_max", F.col("k")))])
    size = F.struct(F.lit(100).alias("width"), F.when(F.col("event_id") % 17 != 0, F.lit(100)).alias("height"))
    target = F.when(F.col("event_id") % 23 != 0, F.struct(F.when(F.col("event_id") % 19 != 0, F.lit(TASK)).alias("task"), size.alias("image_size"), box.alias("seat_contact_box")))
    lines = rows.select(F.col("event_type").alias("file"), F.col("event_id").alias("lineno"), V.target_error(target, F.col("props"), TASK, "bbox").alias("error"))
    report = C.file_report(lines)
    return report.select("file", "n_lines", "n_ok", "n_bad", F.concat_ws("; ", F.transform("errors", lambda e: F.concat(e["lineno"].cast("string"), F.lit(":"), e["error"]))).alias("preview"))


FILE_REPORT = f"""WITH e AS (SELECT event_type AS file, event_id AS lineno, value AS x1, (props::JSON->>'$.k')::INTEGER AS k FROM events),
v AS (SELECT file, lineno, CASE WHEN lineno%23=0 THEN 'assistant target must be a JSON object' WHEN lineno%19=0 THEN 'task must be {TASK}'
 WHEN lineno%17=0 THEN 'image_size.width/height must be integers' WHEN k<0 OR x1>99 OR k>99 THEN 'seat_contact_box out of image boundary'
 WHEN x1<=k OR k<=5 THEN 'seat_contact_box must satisfy x_max>x_min and y_max>y_min' END AS error FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lineno) AS r FROM v WHERE error IS NOT NULL)
SELECT file, count(*) AS n_lines, count(*) FILTER (error IS NULL) AS n_ok, count(error) AS n_bad,
 coalesce((SELECT string_agg(lineno||':'||error,'; ' ORDER BY lineno) FROM b WHERE b.file=v.file AND r<=20),'') AS preview FROM v GROUP BY file"""


def chat_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat rows of files by type, whose answers are polygons; every fifth user's image does not exist."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    path = F.concat(F.lit("images/"), F.col("user_id").cast("string"), F.lit(".png"))
    images = rows.where("user_id % 5 <> 0").select(path.alias("path"))
    at = lambda x, y: F.concat(F.lit('{"x":'), x.cast("string"), F.lit(',"y":'), y.cast("string"), F.lit("}"))
    last = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit(","), at(F.lit(7), F.col("value").cast("int"))))
    polygon = F.concat(F.lit('"seat_contact_polygon":['), at(F.col("k"), F.lit(5)), F.lit(","), at(F.lit(9), F.when(F.col("event_id") % 17 == 0, F.lit("null")).otherwise(F.lit("8"))), last, F.lit("]"))
    note = F.when(F.col("event_id") % 29 == 0, F.lit(',"note":"and so on ..."}')).otherwise(F.lit("}"))
    answer = F.concat(F.lit(f'{{"task":"{X.TASKS[None, None]}","image_size":{{"width":100,"height":100}},'), polygon, note)
    answer = F.when(F.col("event_id") % 23 == 0, F.lit("no json")).otherwise(answer)
    messages = TG.target_messages(F.lit("s"), F.lit("u"), answer)
    lines = rows.select(
        F.col("event_type").alias("file"), F.col("event_id").alias("lineno"),
        F.when(F.col("event_id") % 31 != 0, F.array(path)).alias("images"), F.when(F.col("event_id") % 37 != 0, messages).alias("messages"),
    )
    report = C.file_report(TG.checked_lines(lines, images, X.TASKS[None, None], "polygon", 3))
    return report.select("file", "n_lines", "n_ok", "n_bad", F.concat_ws("; ", F.transform("errors", lambda e: F.concat(e["lineno"].cast("string"), F.lit(":"), e["error"]))).alias("preview"))


CHAT_FILE_REPORT = """WITH e AS (SELECT event_type AS file, event_id AS lineno, user_id, trunc(value)::INTEGER AS v, (props::JSON->>'$.k')::INTEGER AS k FROM events),
w AS (SELECT file, lineno, CASE WHEN lineno%31=0 THEN 'images missing' WHEN lineno%37=0 THEN 'messages missing' WHEN user_id%5=0 THEN 'image does not exist' WHEN lineno%23=0 THEN 'assistant target must be a JSON object'
 WHEN lineno%13=0 THEN 'seat_contact_polygon must contain >=3 points' WHEN lineno%17=0 THEN 'point x/y must be finite numbers' WHEN k<0 OR k>99 OR v<0 OR v>99 THEN 'point out of image boundary'
 WHEN lineno%29=0 THEN 'assistant text contains placeholder-like tokens' END AS error FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lineno) AS r FROM w WHERE error IS NOT NULL)
SELECT file, count(*) AS n_lines, count(*) FILTER (error IS NULL) AS n_ok, count(error) AS n_bad,
 coalesce((SELECT string_agg(lineno||':'||error,'; ' ORDER BY lineno) FROM b WHERE b.file=w.file AND r<=20),'') AS preview FROM w GROUP BY file"""


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages of each language and host, the path that an order by version puts last."""
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    host = F.regexp_extract(path, r"//([^/]+)/", 1)
    return X.last_by_version(table(spark, sf_dir, "pages").select(host.alias("host"), path.alias("path")), ["host"], "path")


LATEST_VERSION = r"""WITH p AS (SELECT regexp_replace(url,'[?#].*$','') AS path FROM pages),
v AS (SELECT regexp_extract(path,'//([^/]+)/',1) AS host, path, coalesce(try_cast(regexp_extract(path,'([0-9]+)[^0-9]*$',1) AS INTEGER),-1) AS version FROM p)
SELECT host, path, version FROM (SELECT DISTINCT *, row_number() OVER (PARTITION BY host ORDER BY version DESC, path DESC) AS r FROM v) WHERE r=1"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record flattened to manifest columns, with a preview of the text."""
    meta = F.struct("lang", "source", F.col("n_chars").alias("chars"), F.struct((F.col("n_chars") % 224).alias("width"), (F.col("n_chars") % 97).alias("height")).alias("size"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", meta.alias("meta"))
    packed = F.concat_ws("|", F.lit("0"), F.lit("0"), F.col("size.width").cast("string"), F.col("size.height").cast("string"))
    return rows.select("doc_id", "meta.*", F.left("text", F.lit(240)).alias("preview")).select("doc_id", "lang", "source", "chars", packed.alias("crop_box"), F.md5("preview").alias("preview_md5"))


MANIFEST = """SELECT doc_id, lang, source, n_chars AS chars, '0|0|'||(n_chars%224)||'|'||(n_chars%97) AS crop_box, md5(left(text,240)) AS preview_md5 FROM documents"""


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each conversation against the expected ones: missing, extra, common, equal, enough."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("keys"))
    expected = F.array(F.lit("assistant"), F.lit("user"))
    join = lambda c: F.concat_ws(",", F.array_sort(c))
    return rows.select(
        "conv_id", join(F.array_except(expected, "keys")).alias("missing"), join(F.array_except("keys", expected)).alias("extra"),
        F.size(F.array_intersect("keys", expected)).alias("n_common"), (F.col("keys") == expected).alias("is_equal"), (F.size(F.array_except(expected, "keys")) == 0).alias("is_superset"),
    )


KEY_SETS = """WITH k AS (SELECT conv_id, bool_or(role='assistant') AS a, bool_or(role='user') AS u, bool_or(role='system') AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(',', CASE WHEN NOT a THEN 'assistant' END, CASE WHEN NOT u THEN 'user' END) AS missing, CASE WHEN s THEN 'system' ELSE '' END AS extra,
 (a::INT+u::INT)::INTEGER AS n_common, a AND u AND NOT s AS is_equal, a AND u AS is_superset FROM k"""


def name_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, ("bbox", "quad", "polygon"))), (F.col("doc_id") % 3 + 1).cast("int"))
    mode = F.when(F.col("doc_id") % 2 == 0, "grid").otherwise("pixel")
    rows = table(spark, sf_dir, "documents").select("doc_id", shape.alias("shape"), mode.alias("mode"), "lang", "source", F.contains(F.lower("text"), F.lit("tired")).alias("is_tired"))
    return rows.select(
        "doc_id", X.task_name(F.col("shape"), F.col("mode")).alias("task"), X.target_key(F.col("shape")).alias("target_key"),
        TG.from_template(TG.SYSTEM, F.col("shape"), F.col("mode"), F.when(F.col("lang") == "en", "chair").otherwise("none"), F.lit(16)).alias("prompt"), "is_tired",
        X.first_filled(F.when(F.col("lang") == "fr", F.lit(" ")).otherwise(F.col("lang")), F.col("source"), F.lit("base")).alias("model"),
    )


def _sql_system(shape: str | None, mode: str | None) -> str:
    return "'" + TG.SYSTEM[shape, mode].replace("{grid}", "16").replace("{hint}", f"'||CASE WHEN lang='en' THEN '{TG.HINT}' ELSE '' END||'") + "'"


NAME_RESOLVER = f"""WITH d AS (SELECT *, ['bbox','quad','polygon'][doc_id%3+1] AS shape, doc_id%2=0 AS grid FROM documents)
SELECT doc_id, CASE WHEN shape='bbox' AND grid THEN 'seat_contact_bounding_box_grid' WHEN shape='bbox' THEN 'seat_contact_bounding_box' WHEN shape='quad' THEN 'seat_contact_quad_points' ELSE 'seat_contact_segmentation_points' END AS task,
 CASE WHEN shape='bbox' THEN 'seat_contact_box' ELSE 'seat_contact_polygon' END AS target_key,
 CASE WHEN shape='bbox' AND grid THEN {_sql_system("bbox", "grid")} WHEN shape='bbox' THEN {_sql_system("bbox", None)} WHEN shape='quad' THEN {_sql_system("quad", None)} ELSE {_sql_system(None, None)} END AS prompt,
 contains(lower(text),'tired') AS is_tired, CASE WHEN lang='fr' THEN source ELSE lang END AS model FROM d"""


def default_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map lookups with defaults and a note where the default was used, and a summary of the table."""
    props = F.from_json("props", "map<string,int>")
    rows = table(spark, sf_dir, "events").select("event_id", props.alias("m"))
    k, z = F.try_element_at("m", F.lit("k")), F.try_element_at("m", F.lit("z"))
    rows = rows.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.coalesce(z, F.lit(35)).alias("z"), F.when(z.isNull(), F.lit("z defaulted")).alias("note"))
    return rows.agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.sum("k").alias("k_sum"), F.sum("z").alias("z_sum"), F.count("note").alias("n_notes"))


DEFAULT_GET = """SELECT count(*) AS n_rows, min(event_id) AS first_id, sum(coalesce((props::JSON->>'$.k')::INTEGER,-1))::BIGINT AS k_sum, (35*count(*))::BIGINT AS z_sum, count(*) AS n_notes FROM events"""


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    issues = F.when(F.col("doc_id") % 4 == 0, F.left("text", F.lit(350)))
    whole = X.assembled(F.concat(F.lit("Answer in "), F.col("lang")), F.when(F.col("doc_id") % 5 != 0, F.to_json(F.struct("doc_id", "source"))), issues)
    return rows.select("doc_id", F.length(whole).alias("n"), F.md5(whole).alias("prompt_md5"))


PROMPT_ASSEMBLY = r"""WITH p AS (SELECT doc_id, concat_ws(chr(10)||chr(10), 'Answer in '||lang, CASE WHEN doc_id%5<>0 THEN 'Input JSON:'||chr(10)||'{"doc_id":'||doc_id||',"source":"'||source||'"}' END,
CASE WHEN doc_id%4=0 THEN 'Previous issues:'||chr(10)||left(text,350) END) AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS prompt_md5 FROM p"""


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    image = F.concat(X.stem(F.col("path")), F.lit(".JPG"))
    steps = X.schedule(F.concat_ws(",", F.lit(" 10"), F.col("page_id").cast("string"), F.lit("x"), F.lit("-3")))
    return rows.select(
        "page_id", X.stem(F.col("path")).alias("stem"), X.suffix(F.col("path")).alias("suffix"), X.media_type(image).alias("media"),
        X.version_number(F.col("path")).alias("version"), F.size(steps).alias("n_steps"),
    )


PATH_PARTS = r"""WITH p AS (SELECT page_id, regexp_replace(url,'[?#].*$','') AS path FROM pages), n AS (SELECT *, regexp_extract(path,'([^/]*)/*$',1) AS name FROM p)
SELECT page_id, regexp_replace(name,'(.)\.[^.]*$','\1') AS stem, lower(regexp_extract(path,'[^/]+(\.[^./]*)/*$',1)) AS suffix, 'image/jpeg' AS media,
 try_cast(regexp_extract(path,'([0-9]+)[^0-9]*$',1) AS INTEGER) AS version, (1+(page_id>0)::INT)::INTEGER AS n_steps FROM n"""

def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as values whose type is not known beforehand, in JSON: what each is, and the number it holds, if any."""
    k = F.col("event_id") % 9
    digits = F.col("value").cast("string")
    raw = F.when(k == 0, digits).when(k == 1, "true").when(k == 2, F.concat(F.lit('"'), digits, F.lit('"'))).when(k == 3, "null").when(k == 4, F.concat(F.lit("["), digits, F.lit("]"))).when(k == 5, F.col("props")).when(k == 6, F.col("user_id").cast("string")).when(k == 7, F.concat(F.lit("-"), F.col("user_id").cast("string"), F.lit("e3"))).otherwise("{no json")
    rows = fixed(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "v", F.try_parse_json("raw"))
    inner = F.try_variant_get("v", "$.k", "variant")
    return rows.select("event_id", jsonx.value_kind(F.col("v")).alias("kind"), jsonx.finite_number(F.col("v")).alias("number"), jsonx.finite_number(inner).alias("k"))


VALUE_KINDS = """WITH r AS (SELECT event_id, props, CASE event_id%9 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN '"'||value||'"' WHEN 3 THEN 'null' WHEN 4 THEN '['||value||']' WHEN 5 THEN props WHEN 6 THEN user_id::VARCHAR WHEN 7 THEN '-'||user_id||'e3' ELSE '{no json' END AS raw FROM events),
t AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN json_type(raw) END AS k FROM r)
SELECT event_id, CASE WHEN k IN ('DOUBLE','BIGINT','UBIGINT') THEN 'number' WHEN k='BOOLEAN' THEN 'boolean' WHEN k='VARCHAR' THEN 'text' WHEN k='NULL' THEN 'null' WHEN k='ARRAY' THEN 'array' WHEN k='OBJECT' THEN 'object' END AS kind,
 CASE WHEN k IN ('DOUBLE','BIGINT','UBIGINT') THEN raw::DOUBLE END AS number, CASE WHEN k='OBJECT' THEN (raw::JSON->>'$.k')::DOUBLE END AS k FROM t"""


def lora_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types and brands as comma-separated lists with blanks between, before and after, some of them blank throughout."""
    text = F.when(F.col("p_partkey") % 7 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), F.regexp_replace("p_type", " ", " , "), F.lit(",, "), "p_brand", F.lit(" ,")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", X.lora_targets(text)).alias("targets"))


LORA_TARGETS = "SELECT p_partkey, CASE WHEN p_partkey%7=0 THEN 'all-linear' ELSE replace(trim(p_type),' ','|')||'|'||trim(p_brand) END AS targets FROM part"


def serialised_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every type as JSON can hold them: numbers, truth values and texts as they are, nested values as JSON, all else as text."""
    nested = F.struct("user_id", F.array("event_type").alias("types"), F.when(F.col("event_id") % 2 == 0, F.lit(1)).alias("even"))
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") > 9).alias("flag"), "event_type", F.to_date("ts").alias("day"), F.col("user_id").cast("decimal(9,2)").alias("amount"), nested.alias("nested"))
    return rows.select("event_id", *[X.serialised(rows, c).alias(c) for c in rows.columns if c != "event_id"])


SERIALISED = """SELECT event_id, value, user_id>9 AS flag, event_type, ts::DATE::VARCHAR AS day, user_id::DECIMAL(9,2)::VARCHAR AS amount,
 '{"user_id":'||user_id||',"types":["'||event_type||'"],"even":'||CASE WHEN event_id%2=0 THEN '1' ELSE 'null' END||'}' AS nested FROM events"""

QUERIES = {
    "chat_rows": (chat_rows, CHAT_ROWS),
    "prompt_completion": (prompt_completion, PROMPT_COMPLETION),
    "placeholder_rate": (placeholder_rate, PLACEHOLDER_RATE),
    "json_props": (json_props, JSON_PROPS),
    "json_recover": (json_recover, JSON_RECOVER),
    "stage_retry": (stage_retry, STAGE_RETRY),
    "value_kinds": (value_kinds, VALUE_KINDS),
    "lora_target_lists": (lora_target_lists, LORA_TARGETS),
    "serialised_columns": (serialised_columns, SERIALISED),
    "file_validation_report": (file_validation_report, FILE_REPORT),
    "chat_file_report": (chat_file_report, CHAT_FILE_REPORT),
    "latest_version": (latest_version, LATEST_VERSION),
    "manifest": (manifest, MANIFEST),
    "key_sets": (key_sets, KEY_SETS),
    "name_resolver": (name_resolver, NAME_RESOLVER),
    "default_get": (default_get, DEFAULT_GET),
    "prompt_assembly": (prompt_assembly, PROMPT_ASSEMBLY),
    "path_parts": (path_parts, PATH_PARTS),
}
