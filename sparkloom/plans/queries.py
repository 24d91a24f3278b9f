"""Queries over the driver's tables for the registry, chat, locale, text and document operators."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locale, text
from ..operators import mutate, registry
from ..sources import files, office
from ..streaming import chat
from . import plugins

Query = Callable[[SparkSession, str], DataFrame]

USER = "src0"
COPIES = 10**12  # numbers of requests for copies begin here
ENDINGS = ("csv", "XLSX", "pdf", "Docx", "pptx", "txt", "csv.bak")
LOCALE_INPUTS = ("", "  ", "fr-FR", "ZH_tw", "zh", "FR", "zh-Hant-TW", "en-GB", "pt-BR", "*", "de_DE", "ja")
ENV_TEXT = "# c\n\nexport A=1\nB = 'two words'\nC=\"x\"\nA=again\nnokey\n=empty\nD=\"\nMODELS= a, b,,a ,c\r\nURL=https://example.org/x"


def _upper(c) -> Column:
    """a-z alone, as engines differ beyond."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as a registry: a skill a document, its source as the user.

    Names are cut before the join, so that only queries that show content send whole texts through it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    cut = docs.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("user_id"),
        F.btrim(F.substring("text", 1, 24), F.lit(" ")).alias("name"),
        F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("source", F.lit(""))).alias("description"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("seq"),
    )
    active = (F.coalesce("quality", F.lit(0)) == 1).alias("is_active")
    return cut.join(labels, "doc_id", "left").select("id", "user_id", "name", "description", "content", active, "seq")


def skills_registry(spark, sf_dir):
    return skills(spark, sf_dir)


def skills_list(spark, sf_dir):
    return registry.list_skills(skills(spark, sf_dir), USER).select("id", "name", "description", "is_active", "updated_at")


def skills_ranked(spark, sf_dir):
    return registry.ranked(skills(spark, sf_dir)).select("user_id", F.col("place").cast("long").alias("place"), "id", "name", "is_active")


def skills_counts_by_user(spark, sf_dir):
    return registry.counts(skills(spark, sf_dir)).withColumnRenamed("count", "n_skills")


def skills_show(spark, sf_dir):
    return registry.show_skill(skills(spark, sf_dir), USER, skill_id=" 40 ", name="No such name")


def skills_first_match(spark, sf_dir):
    asked = skills(spark, sf_dir).select(F.col("id").alias("req_id"), "user_id", (F.col("seq") + 20).cast("string").alias("skill_id"), _upper("name").alias("name"))
    return registry.first_matches(skills(spark, sf_dir), asked)


def skills_name_collisions(spark, sf_dir):
    return registry.name_collisions(skills(spark, sf_dir))


def skills_rename_conflicts(spark, sf_dir):
    s = skills(spark, sf_dir)
    return registry.rename_conflicts(s, s.select("user_id", "id", _upper("name").alias("new_name")))


def _requests(spark, sf_dir):
    """Each nation asks for a skill of its own name and, in other case, for the name that its number's document has."""
    nations = table(spark, sf_dir, "nation")
    own = nations.select(F.col("n_nationkey").cast("long").alias("req_seq"), F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")).alias("new_id"), F.lit(USER).alias("user_id"), F.col("n_name").alias("name"), F.lit("").alias("description"), F.lit("").alias("content"))
    held = skills(spark, sf_dir).join(nations, F.col("seq") == F.col("n_nationkey") * 20)
    known = held.select((F.col("n_nationkey") + 1000).cast("long").alias("req_seq"), F.concat(F.lit("new-"), (F.col("n_nationkey") + 1000).cast("string")).alias("new_id"), F.lit(USER).alias("user_id"), F.concat(F.lit(" "), _upper("name"), F.lit(" ")).alias("name"), F.lit(" d ").alias("description"), F.lit("").alias("content"))
    return own.unionByName(known)


def skills_upsert(spark, sf_dir):
    return mutate.upsert_many(skills(spark, sf_dir), _requests(spark, sf_dir), as_sql=True).select("id", "user_id", "name", "description", "is_active", "seq")


def skills_upsert_all(spark, sf_dir):
    """Every document asks, for its own user, for the skill of its name in other case; every labelled one for a copy too."""
    held = skills(spark, sf_dir)
    again = held.select(F.col("seq").alias("req_seq"), F.concat(F.lit("new-"), "id").alias("new_id"), "user_id", F.concat(F.lit(" "), _upper("name"), F.lit(" ")).alias("name"), F.lit(" d ").alias("description"), F.lit("").alias("content"))
    labelled = held.join(table(spark, sf_dir, "labels").select("doc_id"), F.col("seq") == F.col("doc_id"))
    copies = labelled.select((F.col("seq") + COPIES).alias("req_seq"), F.concat(F.lit("copy-"), "id").alias("new_id"), "user_id", F.concat(F.lit("Copy "), "id").alias("name"), F.lit("").alias("description"), F.lit(" c ").alias("content"))
    made = mutate.upsert_many(held, again.unionByName(copies))
    return made.select("id", "user_id", "name", "description", F.md5("content").alias("content_md5"), "is_active", "seq")


def skills_update(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    asked = skills(spark, sf_dir).join(labels, F.col("seq") == F.col("doc_id")).select("user_id", "id", F.lit("  labelled ").alias("description"), F.lit(" ").alias("content"), F.when(F.col("toxic") == 1, False).alias("is_active"))
    return mutate.update_many(skills(spark, sf_dir), asked)


def skills_delete(spark, sf_dir):
    toxic = skills(spark, sf_dir).join(table(spark, sf_dir, "labels").where("toxic = 1"), F.col("seq") == F.col("doc_id"))
    return mutate.delete_many(skills(spark, sf_dir), toxic.select("user_id", "id")).select("id", "user_id", "name", "is_active", "seq")


def documents_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(t)).alias("lower_md5"), F.length(text.strip_py(t)).cast("long").alias("py_chars"), F.length(text.strip_js(t)).cast("long").alias("js_chars"), text.is_filled(t).alias("filled"))


def action_preview(spark, sf_dir):
    body = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.action_result(chat.body_content(body)).alias("result"))


def tool_processed(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", chat.tool_result(F.col("text")).alias("result"))


def last_assistant_message(spark, sf_dir):
    return chat.last_assistant_message(table(spark, sf_dir, "conversations"))


def conversation_hooks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return chat.outlet(chat.inlet(rows, _upper), lambda c: F.concat(c, F.lit(" [checked]")))


def transcripts(spark, sf_dir):
    made = chat.nested(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("transcript"), F.size("messages").cast("long").alias("n_messages"))


def conversation_pipe(spark, sf_dir):
    return chat.Pipe(answer=lambda t: t.split("\n")).run(table(spark, sf_dir, "conversations"))


def pipe_models(spark, sf_dir):
    tests = table(spark, sf_dir, "region").select("r_name")
    return chat.per_model(chat.Pipe().pipes(spark), tests)


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def conversation_stream(spark, sf_dir):
    """The action hook over a stream of all conversation rows, as Parquet files in the shared folder."""
    at = _shared(spark, "stream")
    hook = lambda rows: rows.select("conv_id", "turn", chat.action_result(F.col("text")).alias("result"))
    chat.stream(spark, f"{sf_dir}/conversations.parquet", hook, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


def resolved_locales(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in LOCALE_INPUTS], "tag string").select("tag", locale.resolve_locale(F.col("tag")).alias("locale"))


def messages_by_user(spark, sf_dir):
    """The listing's closing message for every user, in a language that goes by the user's number."""
    tags = F.array(*[F.lit(x) for x in ("de", "en-US", "pt-BR")])
    n = registry.counts(skills(spark, sf_dir)).withColumn("tag", F.get(tags, F.pmod(F.regexp_extract("user_id", r"(\d+)$", 1).cast("int"), F.lit(3))))
    return n.select("user_id", locale.message(F.col("tag"), F.lit("status_list_done"), count=F.col("count"), active_count=F.col("active_count")).alias("message"))


def catalogue_lookup(spark, sf_dir):
    asked = spark.createDataFrame([("de_de", "err_not_found"), ("de", "status_done"), ("xx", "no_such_key"), (None, "status_listing")], "locale string, key string")
    return locale.look_up(asked, locale.catalogue(spark))


def env_file(spark, sf_dir):
    lines = spark.createDataFrame([(ENV_TEXT,)], "value string").select(F.lit(1).alias("priority"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return files.merged_env(files.env_entries(lines))


def model_ids(spark, sf_dir):
    value = env_file(spark, sf_dir).where("key = 'MODELS'").select(F.explode(text.required_list(F.col("value"), "MODELS")).alias("model_id"))
    return value


def skill_front_matter(spark, sf_dir):
    """Each document as a Markdown skill file, read back into name, description and body."""
    made = F.concat(F.lit("---\nname: "), F.col("id"), F.lit("\ndescription: "), F.col("description"), F.lit("\n---\n"), F.col("content"))
    return skills(spark, sf_dir).select("id", files.front_matter(made).alias("d")).select("id", "d.name", "d.description", F.md5("d.body").alias("body_md5"))


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _office_files(spark, sf_dir):
    """A small document, slide show and workbook whose contents are the regions' names."""
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    docx = _archive({"word/document.xml": "<w:d xmlns:w='w'>" + "".join(f"<w:t>{n}</w:t>" for n in names) + "</w:d>"})
    pptx = _archive({f"ppt/slides/slide{k}.xml": f"<a:s xmlns:a='a'><a:t>{n}</a:t></a:s>" for k, n in zip((1, 2, 10, 11, 3), names, strict=False)})
    rows = "".join(f"<row r='{i}'><c r='A{i}' t='s'><v>{i - 1}</v></c><c r='B{i}'><v>{i * 10}</v></c></row>" for i in range(1, len(names) + 1))
    xlsx = _archive({"xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{n}</t></si>" for n in names) + "</sst>", "xl/worksheets/sheet1.xml": f"<w><sheetData>{rows}</sheetData></w>"})
    return spark.createDataFrame([("a.docx", bytearray(docx)), ("b.pptx", bytearray(pptx)), ("c.xlsx", bytearray(xlsx))], "path string, content binary").withColumn("format", files.file_format(F.col("path")))


def office_texts(spark, sf_dir):
    f = _office_files(spark, sf_dir)
    return office.docx_text(f.where("format = 'docx'")).unionByName(office.pptx_text(f.where("format = 'pptx'")))


def office_cells(spark, sf_dir):
    return office.cells(_office_files(spark, sf_dir).where("format = 'xlsx'"))


def office_sheet(spark, sf_dir):
    return office.first_sheet(_office_files(spark, sf_dir).where("format = 'xlsx'"))


def office_members(spark, sf_dir):
    return office.members(_office_files(spark, sf_dir), suffix=".xml").select("path", "member")


def office_unreadable(spark, sf_dir):
    """One good workbook and, for each region, bytes that are none: these give an error row each and don't fail the rest."""
    bad = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".xlsx")).alias("path"), F.encode("r_name", "UTF-8").alias("content"))
    f = _office_files(spark, sf_dir).where("format = 'xlsx'").select("path", "content").unionByName(bad)
    kept = office.cells(f, permissive=True).groupBy("path").agg(F.count("*").alias("n_cells"))
    return kept.select("path", "n_cells").unionByName(office.unreadable(f, "xlsx_cells").select("path", F.lit(0).cast("long").alias("n_cells")))


def text_functions(spark, sf_dir):
    """Header tags, paths, labels, cell references, slide numbers and XML texts made from the nations."""
    n, k = F.col("n_name"), F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        text.first_tag(F.concat(n, F.lit(";q=0.9,en"))).alias("tag"),
        text.basename(F.concat(F.lit("/data/"), k, F.lit("/"), n)).alias("base"),
        text.resolved_path(F.concat(F.when(k % 2 == 0, "/").otherwise(""), n), "/base/").alias("resolved"),
        text.label_or(F.when(k % 5 == 0, F.lit(" ")).otherwise(n), "none").alias("label"),
        text.is_url(F.concat(F.when(k % 3 == 0, "https://example.org/").otherwise(""), k)).alias("is_url"),
        text.cell_column(F.concat(F.lit("AB"), k + 1)).alias("cell_column"),
        text.cell_row(F.concat(F.lit("AB"), k + 1)).alias("cell_row"),
        text.slide_number(F.concat(F.lit("ppt/slides/slide"), F.when(k > 4, k.cast("string")).otherwise(""), F.lit(".xml"))).alias("slide"),
        F.array_join(text.xml_texts(F.concat(F.lit("<a xmlns:x='u'><x:t>"), n, F.lit("</x:t><t>2</t><b>3</b></a>")), "t"), "|").alias("xml"),
        registry.display_name(F.when(k % 2 == 0, n).otherwise(""), F.when(k % 3 == 0, "").otherwise(k.cast("string"))).alias("shown"),
    )


def skills_requested(spark, sf_dir):
    """The user's registry after single requests, one after the other: two new skills, one overwritten under another
    case, a rename that is refused, one that isn't, an activation, a deletion, and one of a skill that isn't there."""
    ids = iter(("new-1", "new-2"))
    at = mutate.Registry(skills(spark, sf_dir).withColumn("updated_at", F.lit(0)), mutate.User(USER), new_id=lambda: next(ids), now=lambda: 0)
    steps = (
        lambda r: r.create("Fresh one", " about ", "text"),
        lambda r: r.create("Second"),
        lambda r: r.create(" FRESH ONE ", "again"),
        lambda r: r.update(name="second", new_name="fresh ONE"),
        lambda r: r.update(name="second", new_name="Third", content="more"),
        lambda r: r.update(skill_id="new-1", is_active=True),
        lambda r: r.delete(skill_id="40"),
        lambda r: r.delete(name="no such skill"),
    )
    for step in steps:
        out = step(at)
        if out.cause is not None:
            raise out.cause
        at.state = out.state
    return at.state.where(F.col("user_id") == USER).select("id", "name", "description", F.md5("content").alias("content_md5"), "is_active")


def skills_events(spark, sf_dir):
    """The status events of single requests, by step: listings in two languages, a skill shown, one to delete that isn't
    there, a registry that isn't there, and a listing whose user wants no events."""
    state = skills(spark, sf_dir)

    def asks(of=state, language=locale.DEFAULT, **kw):
        return mutate.Registry(of, mutate.User(USER, language=language), mutate.Valves(**kw), emit=lambda e: None)

    outcomes = (
        asks().list(),
        asks(language="de-DE").list(),
        asks().show(skill_id="40"),
        asks().delete(name="no such skill"),
        asks(None).list(),
        asks(show_status=False).list(),
    )
    events = [(step, n, e["data"]["description"], e["data"]["done"]) for step, out in enumerate(outcomes) for n, e in enumerate(out.events)]
    return spark.createDataFrame(events, "step int, n int, description string, done boolean")


def csv_uploads(spark, sf_dir):
    """The customers as an uploaded CSV file, read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    at = _shared(spark, "csv")
    rows.write.option("header", True).csv(at)
    return files.csv_uploads(spark, at, rows.schema)


def file_formats(spark, sf_dir):
    """The format that an upload's name tells, for a name made from each part."""
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), F.pmod("p_partkey", F.lit(len(ENDINGS))).cast("int"))
    path = F.concat(F.lit("/up.csv/"), "p_name", F.lit("."), ending)
    return table(spark, sf_dir, "part").select("p_partkey", text.basename(path).alias("file"), files.file_format(path).alias("format"))


def plugin_manifests(spark, sf_dir):
    """The manifest of a plugin file made from each nation: lines with a colon in its first docstring alone."""
    source = F.concat(F.lit('"""\ntitle: '), "n_name", F.lit("\n  version : 1."), "n_nationkey", F.lit('\nno pair\nlink: a:b\n"""\nx: int = 1\n'))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(files.manifest(source)).alias("m")).select("n_nationkey", "m.key", "m.value")


@dataclass(frozen=True)
class _Marks:
    before: str = "<"
    after: str = ">"


def plugin_chain(spark, sf_dir):
    """Two filters over the customers in the order of their names, with a setting of the user's, and then a tool that
    knows who asks."""
    held = plugins.Plugins()
    held.register(plugins.Extension("filter", "b_mark", lambda d, c: d.withColumn("label", F.concat(F.lit(c.settings.before), "label", F.lit(c.settings.after))), _Marks()))
    held.register(plugins.Extension("filter", "a_upper", lambda d, c: d.withColumn("label", _upper("label")), _Marks()))
    held.register(plugins.Extension("tool", "ask", lambda d, c: d.withColumn("asker", F.lit(c.user["id"]))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label"))
    return held.run("tool", "ask", held.chain("filter", rows, after="!"), user={"id": USER})


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    skills_list, skills_registry, skills_ranked, skills_counts_by_user, skills_show, skills_first_match, skills_name_collisions, skills_rename_conflicts,
    skills_upsert, skills_upsert_all, skills_update, skills_delete, documents_text, action_preview, tool_processed, last_assistant_message, conversation_hooks, transcripts,
    conversation_pipe, pipe_models, conversation_stream, resolved_locales, messages_by_user, catalogue_lookup, env_file, model_ids, skill_front_matter,
    office_texts, office_cells, office_sheet, office_members, office_unreadable, text_functions, skills_requested,
    skills_events, csv_uploads, file_formats, plugin_manifests, plugin_chain,
)}


def _sql_upper(c: str) -> str:
    return f"translate({c}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _characters(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


_SKILLS = """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source AS user_id, trim(substr(d.text, 1, 24), ' ') AS name,
  concat(d.lang, ' ', d.source) AS description, d.text AS content, coalesce(l.quality, 0) = 1 AS is_active, d.doc_id AS seq
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _with_skills(sql: str) -> str:
    return f"WITH skills AS ({_SKILLS}) {sql}"


_UPSERT = f"""WITH skills AS ({_SKILLS}), req AS (
  SELECT CAST(n_nationkey AS BIGINT) AS req_seq, concat('new-', n_nationkey) AS new_id, n_name AS name, n_name AS description, lower(n_name) AS k FROM nation
  UNION ALL SELECT n_nationkey + 1000, concat('new-', n_nationkey + 1000), {_sql_upper('s.name')}, 'd', lower({_sql_upper('s.name')}) FROM nation n JOIN skills s ON s.seq = n.n_nationkey * 20),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY req_seq DESC) AS rn FROM req) WHERE rn = 1),
first AS (SELECT lower(name) AS k, min(seq) AS seq FROM skills WHERE user_id = '{USER}' GROUP BY 1)
SELECT s.id, s.user_id, coalesce(r.name, s.name) AS name, coalesce(r.description, s.description) AS description,
  CASE WHEN r.k IS NULL THEN s.is_active ELSE false END AS is_active, s.seq
FROM skills s LEFT JOIN first f ON s.user_id = '{USER}' AND s.seq = f.seq LEFT JOIN last r ON f.k = r.k
UNION ALL
SELECT r.new_id, '{USER}', r.name, r.description, false, (SELECT max(seq) FROM skills) + 1 + r.req_seq FROM last r WHERE r.k NOT IN (SELECT k FROM first)"""

_UPSERT_ALL = f"""WITH skills AS ({_SKILLS}), req AS (
  SELECT seq AS req_seq, concat('new-', id) AS new_id, user_id, trim({_sql_upper('name')}, {_characters(text.WS_PY)}) AS name, 'd' AS description, 'd' AS content FROM skills
  UNION ALL SELECT s.seq + {COPIES}, concat('copy-', s.id), s.user_id, concat('Copy ', s.id), concat('Copy ', s.id), 'c' FROM skills s JOIN labels l ON l.doc_id = s.seq),
last AS (SELECT *, lower(name) AS k FROM req WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY user_id, lower(name) ORDER BY req_seq DESC) = 1),
first AS (SELECT user_id, lower(name) AS k, min(seq) AS seq FROM skills GROUP BY 1, 2)
SELECT s.id, s.user_id, coalesce(r.name, s.name) AS name, coalesce(r.description, s.description) AS description,
  md5(coalesce(r.content, s.content)) AS content_md5, CASE WHEN r.k IS NULL THEN s.is_active ELSE false END AS is_active, s.seq
FROM skills s LEFT JOIN first f ON s.user_id = f.user_id AND s.seq = f.seq LEFT JOIN last r ON f.user_id = r.user_id AND f.k = r.k
UNION ALL
SELECT r.new_id, r.user_id, r.name, r.description, md5(r.content), false, (SELECT max(seq) FROM skills) + 1 + r.req_seq
FROM last r WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.user_id = r.user_id AND f.k = r.k)"""

_LOCALES = " ".join(f"WHEN lower(n) = '{v.lower()}' THEN '{v}'" for v in locale.LOCALES)
_BASES = " ".join(f"WHEN lower(split_part(n, '-', 1)) = '{k.lower()}' THEN '{v}'" for k, v in locale.FALLBACKS.items())

ORACLE_SQL: dict[str, str] = {
    "skills_registry": _SKILLS,
    "skills_list": _with_skills(f"SELECT id, name, description, is_active, '' AS updated_at FROM skills WHERE user_id = '{USER}'"),
    "skills_ranked": _with_skills("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY lower(name), seq) AS place, id, name, is_active FROM skills"),
    "skills_counts_by_user": _with_skills("SELECT user_id, count(*) AS n_skills, count(*) FILTER (WHERE is_active) AS active_count FROM skills GROUP BY user_id"),
    "skills_show": _with_skills(f"SELECT id, name, description, is_active, '' AS updated_at, content FROM skills WHERE user_id = '{USER}' AND (id = '40' OR lower(name) = 'no such name') ORDER BY seq LIMIT 1"),
    "skills_first_match": _with_skills(f"SELECT q.id AS req_id, min_by(s.id, s.seq) AS id FROM skills q JOIN skills s ON q.user_id = s.user_id AND (s.id = CAST(q.seq + 20 AS VARCHAR) OR (lower(s.name) = lower(trim({_sql_upper('q.name')}, {_characters(text.WS_PY)})) AND trim(q.name, {_characters(text.WS_PY)}) <> '')) GROUP BY q.id"),
    "skills_name_collisions": _with_skills("SELECT id, user_id, lower(name) AS name_key, count(*) OVER (PARTITION BY user_id, lower(name)) AS holders FROM skills QUALIFY holders > 1"),
    "skills_rename_conflicts": _with_skills(f"SELECT user_id, id, {_sql_upper('name')} AS new_name FROM skills a WHERE name <> '' AND EXISTS (SELECT 1 FROM skills b WHERE b.user_id = a.user_id AND lower(b.name) = lower(trim({_sql_upper('a.name')}, {_characters(text.WS_PY)})) AND b.id <> a.id)"),
    "skills_upsert": _UPSERT,
    "skills_upsert_all": _UPSERT_ALL,
    "skills_update": _with_skills("SELECT s.id, s.user_id, s.name, CASE WHEN l.doc_id IS NULL THEN s.description ELSE 'labelled' END AS description, s.content, CASE WHEN l.toxic = 1 THEN false ELSE s.is_active END AS is_active, s.seq FROM skills s LEFT JOIN labels l ON s.seq = l.doc_id"),
    "skills_delete": _with_skills("SELECT id, user_id, name, is_active, seq FROM skills WHERE seq NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "documents_text": f"SELECT doc_id, md5(lower(text)) AS lower_md5, length(trim(text, {_characters(text.WS_PY)})) AS py_chars, length(trim(text, {_characters(text.WS_JS)})) AS js_chars, length(trim(text, {_characters(text.WS_PY)})) > 0 AS filled FROM documents",
    "action_preview": "SELECT conv_id, turn, concat('Action processed: ', substr(coalesce(text, ''), 1, 50), '...') AS result FROM conversations",
    "tool_processed": "SELECT conv_id, turn, concat('Processed: ', coalesce(text, '')) AS result FROM conversations WHERE role = 'user'",
    "last_assistant_message": f"SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND length(trim(text, {_characters(text.WS_JS)})) > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1",
    "conversation_hooks": f"SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'system') THEN {_sql_upper('text')} WHEN role = 'assistant' THEN concat(text, ' [checked]') ELSE text END AS text FROM conversations",
    "transcripts": "SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, role, text) AS transcript, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "conversation_pipe": "SELECT conv_id, turn, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS INTEGER) AS chunk, unnest(string_split(text, chr(10))) AS text FROM conversations WHERE role = 'user'",
    "pipe_models": "SELECT r_name, m AS model_id FROM region, (VALUES ('model-1'), ('model-2')) v(m)",
    "conversation_stream": "SELECT conv_id, turn, concat('Action processed: ', substr(coalesce(text, ''), 1, 50), '...') AS result FROM conversations",
    "resolved_locales": f"SELECT tag, CASE WHEN trim(tag) = '' THEN 'en-US' {_LOCALES} {_BASES} ELSE 'en-US' END AS locale FROM (SELECT tag, replace(trim(tag), '_', '-') AS n FROM (VALUES {', '.join(f"('{x}')" for x in LOCALE_INPUTS)}) v(tag))",
    "messages_by_user": _with_skills("SELECT user_id, CASE CAST(regexp_extract(user_id, '([0-9]+)$', 1) AS INTEGER) % 3 WHEN 0 THEN concat(count(*), ' Skills, davon ', count(*) FILTER (WHERE is_active), ' aktiv') ELSE concat(count(*), ' skills, ', count(*) FILTER (WHERE is_active), ' of them active') END AS message FROM skills GROUP BY user_id"),
    "catalogue_lookup": "SELECT * FROM (VALUES ('de_de', 'err_not_found', 'Skill nicht gefunden'), ('de', 'status_done', 'Finished'), ('xx', 'no_such_key', 'no_such_key'), (NULL, 'status_listing', 'Reading the list of skills')) v(locale, key, text)",
    "env_file": "SELECT * FROM (VALUES ('A', '1'), ('B', 'two words'), ('C', 'x'), ('D', ''), ('MODELS', 'a, b,,a ,c'), ('URL', 'https://example.org/x')) v(key, value)",
    "model_ids": "SELECT * FROM (VALUES ('a'), ('b'), ('c')) v(model_id)",
    "office_texts": """SELECT 'a.docx' AS path, string_agg(r_name, ' ' ORDER BY r_regionkey) AS text FROM region
UNION ALL SELECT 'b.pptx', string_agg(concat('Slide ', k, ': ', r_name), chr(10) ORDER BY k) FROM (SELECT r_name, ['1', '2', '10', '11', '3'][r_regionkey + 1] AS k FROM region)""",
    "office_cells": """SELECT 'c.xlsx' AS path, 1 AS sheet, r_regionkey + 1 AS row_num, col, CASE WHEN col = 'A' THEN r_name ELSE CAST((r_regionkey + 1) * 10 AS VARCHAR) END AS value
FROM region, (VALUES ('A'), ('B')) v(col)""",
    "office_sheet": "SELECT r_regionkey + 1 AS row_num, r_name AS \"A\", CAST((r_regionkey + 1) * 10 AS VARCHAR) AS \"B\" FROM region WHERE r_regionkey > 0",
    "office_members": """SELECT 'a.docx' AS path, 'word/document.xml' AS member UNION ALL SELECT 'b.pptx', concat('ppt/slides/slide', ['1', '2', '10', '11', '3'][r_regionkey + 1], '.xml') FROM region
UNION ALL SELECT 'c.xlsx', unnest(['xl/sharedStrings.xml', 'xl/worksheets/sheet1.xml'])""",
    "office_unreadable": "SELECT 'c.xlsx' AS path, 2 * count(*) AS n_cells FROM region UNION ALL SELECT concat(r_name, '.xlsx'), 0 FROM region",
    "text_functions": """SELECT n_nationkey, n_name AS tag, n_name AS base, concat(CASE WHEN n_nationkey % 2 = 0 THEN '/' ELSE '/base/' END, n_name) AS resolved,
  CASE WHEN n_nationkey % 5 = 0 THEN 'none' ELSE n_name END AS label, n_nationkey % 3 = 0 AS is_url, 'AB' AS cell_column, n_nationkey + 1 AS cell_row,
  CASE WHEN n_nationkey > 4 THEN CAST(n_nationkey AS VARCHAR) ELSE '?' END AS slide, concat(n_name, '|2') AS xml,
  CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 3 = 0 THEN 'unknown' ELSE CAST(n_nationkey AS VARCHAR) END AS shown FROM nation""",
    "skills_requested": _with_skills(f"""SELECT id, name, description, md5(content) AS content_md5, is_active FROM skills WHERE user_id = '{USER}' AND id <> '40'
UNION ALL SELECT 'new-1', 'FRESH ONE', 'again', md5('again'), true UNION ALL SELECT 'new-2', 'Third', 'Second', md5('more'), false"""),
    "skills_events": _with_skills(f"""SELECT CAST(step AS INTEGER) AS step, CAST(n AS INTEGER) AS n, description, n = 1 OR step = 4 AS done FROM (
  SELECT 0 AS step, 0 AS n, 'Reading the list of skills' AS description
  UNION ALL SELECT 0, 1, concat(count(*), ' skills, ', count(*) FILTER (WHERE is_active), ' of them active') FROM skills WHERE user_id = '{USER}'
  UNION ALL SELECT 1, 0, 'Liste der Skills wird gelesen'
  UNION ALL SELECT 1, 1, concat(count(*), ' Skills, davon ', count(*) FILTER (WHERE is_active), ' aktiv') FROM skills WHERE user_id = '{USER}'
  UNION ALL SELECT 2, 0, 'Reading the skill'
  UNION ALL SELECT 2, 1, coalesce(max(concat('Read ', CASE WHEN name = '' THEN id ELSE name END)), 'No such skill') FROM skills WHERE user_id = '{USER}' AND id = '40'
  UNION ALL SELECT * FROM (VALUES (3, 0, 'Removing the skill'), (3, 1, 'No such skill'), (4, 0, 'The skill registry can''t be reached')) v)"""),
    "csv_uploads": "SELECT c_custkey, c_name, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer",
    "file_formats": f"""SELECT p_partkey, concat(p_name, '.', e) AS file, CASE WHEN lower(e) IN ('csv', 'xlsx', 'pdf', 'docx', 'pptx') THEN lower(e) END AS format
FROM (SELECT p_partkey, p_name, [{', '.join(f"'{e}'" for e in ENDINGS)}][p_partkey % {len(ENDINGS)} + 1] AS e FROM part)""",
    "plugin_manifests": """SELECT n_nationkey, 'title' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'version', concat('1.', n_nationkey) FROM nation
UNION ALL SELECT n_nationkey, 'link', 'a:b' FROM nation""",
    "plugin_chain": f"SELECT c_custkey, concat('<', {_sql_upper('c_name')}, '!') AS label, '{USER}' AS asker FROM customer",
    "skill_front_matter": _with_skills("SELECT id, id AS name, description, md5(content) AS body_md5 FROM skills"),
}
