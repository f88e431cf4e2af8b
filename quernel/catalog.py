"""The registered queries of the retrieval operators over the driver's tables, and their DuckDB SQL.

``documents`` stand for notes (path source/doc_id.md, language as tag),
``embeddings`` for their vectors, ``conversations`` for notes with frontmatter,
headings and wikilinks, and for a link graph: each turn links to the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Index, Search
from .functions import text as tx
from .functions.embed import HashingEmbedder, embed_chunks
from .functions.frontmatter import frontmatter
from .operators import chunks, fulltext, graph, hybrid, links, vectors
from .operators.context import context_window
from .plans import index
from .plans.engine import Engine
from .plans.query_language import parse
from .sources import notes as folder
from .sources.scratch import shared_folder
from .streaming import watch as watching

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Scores are rounded to this many places before they are ordered, so that ties agree.
DIGITS = 6
WORDS = "from une which"


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Tables as the operators want them, and the same in SQL.


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, d, "documents").select(
        "doc_id", path.alias("path"), F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("tags"), F.col("text").alias("body"), F.col("text").alias("content")
    )


def note_vectors(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    last = F.size(tx.lines(F.col("body")))
    return notes(spark, d).join(held, "doc_id").select("doc_id", "path", "title", "tags", F.lit("").alias("heading"), F.lit(1).alias("start_line"), last.alias("end_line"), F.col("body").alias("text"), "embedding")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return read(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first().embedding


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """A note for each conversation: frontmatter, a heading and a link for each turn, one fenced link."""
    turn = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nsee [["), (F.col("conv_id") + F.col("turn") + 1).cast("string"), F.lit("|next]] and `[[no]]`\n"))
    one = F.array_sort(F.collect_list(F.struct("turn", turn.alias("t"))))
    text = F.array_join(F.transform(one, lambda x: x["t"]), "")
    head = F.concat(F.lit("---\ntitle: Conversation "), F.col("conv_id").cast("string"), F.lit("\ntags: [Chat, Log]\n---\nOpening words\nof a note.\n\n"))
    folders = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md"))
    grouped = read(spark, d, "conversations").groupBy("conv_id").agg(text.alias("t"))
    return grouped.select("conv_id", folders.alias("path"), F.concat(head, F.col("t"), F.lit("```\n[[fenced]]\n```\n")).alias("content"))


def turn_links(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn")
    name = lambda c, t: F.concat(F.lit("conv/"), c.cast("string"), F.lit("-"), t.cast("string"), F.lit(".md"))
    conv, turn = F.col("conv_id"), F.col("turn")
    back = turns.where("turn > 0").select(name(conv, turn).alias("source_path"), name(conv, turn - 1).alias("target_path"), F.lit("back").alias("context"))
    across = turns.where("turn = 0 AND conv_id > 0").select(name(conv, turn).alias("source_path"), name(F.floor(conv / 2), turn).alias("target_path"), F.lit("across").alias("context"))
    return back.unionByName(across).distinct()


LINES_OF = "CASE WHEN {0} = '' THEN [] WHEN {0} LIKE '%' || chr(10) THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END"
NOTES = "notes AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, doc_id::VARCHAR AS title, lang AS tags, text AS body FROM documents)"
VECTORS = NOTES + f", vectors AS (SELECT n.*, 1 AS start_line, len({LINES_OF.format('body')})::INTEGER AS end_line, embedding FROM notes n JOIN embeddings e ON e.vec_id = n.doc_id)"
SCORED = VECTORS + ", scored AS (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM vectors)"
MARKDOWN = """markdown AS (SELECT conv_id, 'conv/' || conv_id || '.md' AS path,
  '---' || chr(10) || 'title: Conversation ' || conv_id || chr(10) || 'tags: [Chat, Log]' || chr(10) || '---' || chr(10) || 'Opening words' || chr(10) || 'of a note.' || chr(10) || chr(10)
  || string_agg('## Turn ' || turn || chr(10) || coalesce(text, '') || chr(10) || 'see [[' || (conv_id + turn + 1) || '|next]] and `[[no]]`' || chr(10), '' ORDER BY turn)
  || '```' || chr(10) || '[[fenced]]' || chr(10) || '```' || chr(10) AS content FROM conversations GROUP BY conv_id)"""
LINKS = """links AS (SELECT DISTINCT * FROM (
  SELECT 'conv/' || conv_id || '-' || turn || '.md' AS source_path, 'conv/' || conv_id || '-' || (turn - 1) || '.md' AS target_path, 'back' AS context FROM conversations WHERE turn > 0
  UNION ALL SELECT 'conv/' || conv_id || '-' || turn || '.md', 'conv/' || (conv_id // 2) || '-' || turn || '.md', 'across' FROM conversations WHERE turn = 0 AND conv_id > 0))"""
BOTH = "both_ways AS (SELECT source_path AS here, target_path AS there FROM links UNION SELECT target_path, source_path FROM links)"


def _words(column: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({column}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: CASE WHEN strlen(x) < 40 THEN lower(x) END)"


PLACES = NOTES + ", places AS (" + " UNION ALL ".join(
    f"SELECT path, title, '{f}' AS field, w.t AS term, w.i AS position FROM (SELECT path, title, unnest(list_transform({_words(f)}, lambda x, i: {{'t': x, 'i': i - 1}})) AS w FROM notes) WHERE w.t IS NOT NULL"
    for f in ("title", "body", "tags")
) + ")"


def _bm25(terms: list[tuple[str, str, float]], where: str = "true", limit: int = 20) -> str:
    """Ranking by (field, word, boost), in SQL; where: a condition on the list ``hit`` of a document's 'field:word'."""
    wanted = ", ".join(f"('{f}', '{t}', {b}::DOUBLE)" for f, t, b in terms)
    return PLACES + f""", n AS (SELECT count(*) AS docs FROM notes), wanted(field, term, boost) AS (VALUES {wanted}),
dl AS (SELECT path, field, count(*) AS dl FROM places GROUP BY path, field),
mean AS (SELECT field, count(*) / (SELECT docs FROM n) AS mean FROM places GROUP BY field),
tf AS (SELECT path, any_value(title) AS title, field, term, count(*)::DOUBLE AS tf FROM places GROUP BY path, field, term),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
hits AS (SELECT path, any_value(title) AS title, list(field || ':' || term) AS hit,
  sum(boost * ln(1 + (docs - df + 0.5E0) / (df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * dl / mean))) AS score
  FROM wanted JOIN tf USING (field, term) JOIN df USING (field, term) JOIN dl USING (path, field) JOIN mean USING (field) CROSS JOIN n GROUP BY path)
, found AS (SELECT path, title, round(score, 6) AS score FROM hits WHERE {where} ORDER BY score DESC, path LIMIT {limit})"""


def _fields(words: str, boost: float = 1.0) -> list[tuple[str, str, float]]:
    return [(f, w, boost) for w in words.split() for f in ("title", "body", "tags")]


# Sources.


@query(f"WITH {NOTES} SELECT path, strlen(body)::BIGINT AS length, sha256(body) AS content_hash FROM notes WHERE doc_id % 10 NOT IN (1, 2, 3, 4)")
def scan_notes(spark, d):
    """The documents as files, some in excluded folders, some of other kinds."""
    n, path = F.col("doc_id") % 10, F.col("path")
    placed = F.when(n == 1, F.concat(F.lit(".git/"), path)).when(n == 2, F.concat(path, F.lit(".txt"))).when(n == 3, F.concat("title", F.lit("/node_modules/x.md"))).when(n == 4, F.concat(path, F.lit("/.md")))
    files = notes(spark, d).withColumn("path", F.coalesce(placed, path))
    return folder.notes_of(files).select("path", F.octet_length("content").cast("long").alias("length"), tx.content_hash(F.col("content")).alias("content_hash"))


@query(f"WITH {NOTES} SELECT path, body AS content FROM notes WHERE path = 'src3/3.md'")
def note_get(spark, d):
    return folder.find_note(notes(spark, d), "src3/3.md")


@query(f"WITH {NOTES} SELECT DISTINCT string_split(path, '/')[1] AS name, true AS is_dir, string_split(path, '/')[1] AS path FROM notes")
def list_folder(spark, d):
    return folder.folder_of(notes(spark, d))


@query(f"WITH {NOTES} SELECT DISTINCT string_split(path, '/')[1] AS name, true AS is_dir, string_split(path, '/')[1] AS path FROM notes UNION ALL SELECT DISTINCT string_split(path, '/')[2], false, path FROM notes")
def list_recursive(spark, d):
    return folder.folder_of(notes(spark, d), recursive=True)


# Parsing and projection.


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {NOTES} SELECT path, doc_id::VARCHAR AS title, [tags, 'doc'] AS tags FROM notes")
def title_tags_projection(spark, d):
    return notes(spark, d).select("path", tx.note_title(F.lit(None).cast("string"), F.col("path")).alias("title"), tx.csv_tags(F.concat("tags", F.lit(",,doc"))).alias("tags"))


@query("SELECT doc_id, (len(regexp_replace(text, '[\\x{0}-\\x{2FFF}]', '', 'g')) * 10 // 15 + (len(text) - len(regexp_replace(text, '[\\x{0}-\\x{2FFF}]', '', 'g'))) // 4 + 1)::INTEGER AS tokens FROM documents")
def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


WIDE = "replace(replace(text, 'e', '好'), 'a', '日é')"


@query(f"SELECT doc_id, (len(regexp_replace({WIDE}, '[\\x{{0}}-\\x{{2FFF}}]', '', 'g')) * 10 // 15 + (len({WIDE}) - len(regexp_replace({WIDE}, '[\\x{{0}}-\\x{{2FFF}}]', '', 'g'))) // 4 + 1)::INTEGER AS tokens FROM documents")
def token_estimate_wide(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.expr(WIDE)).alias("tokens"))


@query("""WITH l AS (SELECT conv_id, turn, repeat(' ', conv_id % 4) || repeat('#', 1 + turn) || CASE conv_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE '   ' END || 'Turn ' || turn || CASE WHEN conv_id % 2 = 0 THEN '  ' ELSE '' END AS line,
  conv_id % 3 <> 1 AND turn < 6 AS heads FROM conversations)
SELECT conv_id, turn, line, CASE WHEN heads THEN 1 + turn ELSE 0 END::INTEGER AS level, CASE WHEN heads THEN 'Turn ' || turn ELSE '' END AS heading FROM l""")
def heading_levels(spark, d):
    """Headings of one to eight marks, indented, spaced out, or without a space."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id")
    gap = F.when(conv % 3 == 0, " ").when(conv % 3 == 1, "").otherwise("   ")
    line = F.concat(F.repeat(F.lit(" "), (conv % 4).cast("int")), F.repeat(F.lit("#"), (F.col("turn") + 1).cast("int")), gap, F.lit("Turn "), turn, F.when(conv % 2 == 0, "  ").otherwise(""))
    made = read(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    return made.select("conv_id", "turn", "line", tx.heading_level(F.col("line")).alias("level"), tx.heading_text(F.col("line")).alias("heading"))


@query(f"WITH {MARKDOWN}, l AS (SELECT path, unnest({LINES_OF.format('content')}) AS line FROM markdown) SELECT path, line, 2 AS level, line[4:] AS heading FROM l WHERE line LIKE '## %'")
def heading_detect(spark, d):
    each = markdown(spark, d).select("path", F.explode(tx.lines(F.col("content"))).alias("line"))
    return each.select("path", "line", tx.heading_level(F.col("line")).alias("level"), tx.heading_text(F.col("line")).alias("heading")).where("level > 0")


@query(f"WITH {MARKDOWN} SELECT path, 'Conversation ' || conv_id AS title, ['chat', 'log'] AS tags, 'Opening words of a note.' AS summary, strlen(('---' || chr(10) || 'title: Conversation ' || conv_id || chr(10) || 'tags: [Chat, Log]' || chr(10) || '---' || chr(10)))::INTEGER AS body_start FROM markdown")
def frontmatter_parse(spark, d):
    return markdown(spark, d).withColumn("fm", frontmatter("content")).select("path", "fm.title", "fm.tags", "fm.summary", "fm.body_start")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (2, 3) THEN 'Note ' || doc_id END AS title,
  CASE doc_id % 5 WHEN 2 THEN ['ai', 'b ' || doc_id] WHEN 3 THEN ['single'] ELSE []::VARCHAR[] END AS tags,
  CASE WHEN doc_id % 5 = 1 THEN '---' || chr(10) || 'title: T' || chr(10) ELSE '' END || 'Body of ' || doc_id || ', in ' || lang || '.' AS body FROM documents""")
def frontmatter_variants(spark, d):
    """None, one that isn't closed, a list of tags, a single tag, and one with a summary alone."""
    doc, rest = F.col("doc_id").cast("string"), F.concat(F.lit("Body of "), F.col("doc_id").cast("string"), F.lit(", in "), "lang", F.lit("."))
    heads = [
        F.lit(""), F.lit("---\ntitle: T\n"), F.concat(F.lit("---\ntitle: Note "), doc, F.lit("\ntags:\n  - Ai\n  - B "), doc, F.lit("\n---\n")),
        F.concat(F.lit("---\ntitle: Note "), doc, F.lit("\ntags: Single\n---\n")), F.lit("---\nsummary: Given\n---\n"),
    ]
    content = F.concat(F.element_at(F.array(*heads), (F.col("doc_id") % 5 + 1).cast("int")), rest)
    made = read(spark, d, "documents").select("doc_id", content.alias("content")).withColumn("fm", frontmatter("content"))
    return made.select("doc_id", "fm.title", "fm.tags", "fm.body")


CHUNKS = """RECURSIVE {notes}, l AS (SELECT doc_id, x.i AS i, x.line AS line, (len(x.line) // 4 + 1) AS cost, trim(x.line) <> '' AS filled
  FROM (SELECT doc_id, unnest(list_transform({lines}, lambda x, i: {{'i': i, 'line': x}})) AS x FROM notes)),
fold AS (SELECT doc_id, i, 0 AS chunk_ix, i AS first, cost AS spent, filled FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN f.filled AND f.spent + l.cost > 120 THEN f.chunk_ix + 1 ELSE f.chunk_ix END,
    CASE WHEN f.filled AND f.spent + l.cost > 120 THEN l.i ELSE f.first END,
    CASE WHEN f.filled AND f.spent + l.cost > 120 THEN l.cost ELSE f.spent + l.cost END,
    CASE WHEN f.filled AND f.spent + l.cost > 120 THEN l.filled ELSE f.filled OR l.filled END
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
c AS (SELECT f.doc_id, f.first::INTEGER AS start_line, max(f.i)::INTEGER AS end_line, trim(string_agg(l.line, chr(10) ORDER BY f.i), ' ' || chr(10)) AS text
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY f.doc_id, f.first)""".format(notes=NOTES, lines=LINES_OF.format("body"))


@query(f"WITH {CHUNKS} SELECT n.path, c.start_line, c.end_line, c.text FROM c JOIN notes n ON n.doc_id = c.doc_id WHERE c.text <> ''")
def chunk_lines(spark, d):
    plain = notes(spark, d).withColumn("body_line_offset", F.lit(0))
    return chunks.chunk_notes(plain, 120).select("path", "start_line", "end_line", "text")


@query(f"""WITH {MARKDOWN}, parts AS (SELECT path, conv_id, unnest(list_transform(string_split(string_split(content, chr(10) || '---' || chr(10))[2], chr(10) || '## '), lambda x, i: {{'i': i, 'x': x}})) AS p FROM markdown),
c AS (SELECT path, conv_id, p.i AS i, CASE WHEN p.i > 1 THEN '## ' ELSE '' END || p.x AS text FROM parts)
SELECT path, (i - 1)::INTEGER AS chunk_ix, CASE WHEN i > 1 THEN 'Conversation ' || conv_id || ' > ' || string_split(text, chr(10))[1][4:] ELSE NULL END AS heading,
  CASE WHEN i > 1 THEN 'Conversation ' || conv_id || ' > ' || string_split(text, chr(10))[1][4:] || chr(10) || chr(10) ELSE '' END || trim(text, ' ' || chr(10)) AS input FROM c""")
def chunk_markdown(spark, d):
    out = chunks.chunk_notes(index.parsed(markdown(spark, d)), 100_000)
    return out.select("path", "chunk_ix", "heading", tx.embedding_input(F.col("heading"), F.col("text")).alias("input"))


WIKI = f"""{MARKDOWN}, found AS (SELECT conv_id, path AS source_path, (conv_id + turn + 1)::VARCHAR AS target, 'see [[' || (conv_id + turn + 1) || '|next]] and `[[no]]`' AS context
  FROM conversations JOIN markdown USING (conv_id))"""


@query(f"WITH {WIKI} SELECT source_path, target, 'next' AS alias, context FROM found")
def wikilink_parse(spark, d):
    return links.wikilinks(markdown(spark, d))


@query(f"WITH {WIKI} SELECT DISTINCT source_path, 'conv/' || target || '.md' AS target_path, context FROM found WHERE 'conv/' || target || '.md' IN (SELECT path FROM markdown)")
def wikilink_resolve(spark, d):
    return links.extract_links(markdown(spark, d))


@query(f"""WITH {NOTES}, found AS (SELECT path AS source_path, 'See [[' || (doc_id // 2) || ']], [[src3/3]] and [[none]].' AS context, doc_id // 2 AS target FROM notes)
SELECT source_path, n.path AS target_path, context FROM found JOIN notes n ON n.doc_id = found.target UNION SELECT source_path, 'src3/3.md', context FROM found""")
def wikilink_names(spark, d):
    """Links by a bare name that a note in a deeper folder has too, and by a whole path."""
    held = notes(spark, d)
    context = F.concat(F.lit("See [["), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("]], [[src3/3]] and [[none]]."))
    plain = held.select("path", context.alias("content"))
    deep = held.where("doc_id % 2 = 0").select(F.concat(F.lit("deep/er/"), "path").alias("path"), F.lit("").alias("content"))
    return links.extract_links(plain.unionByName(deep))


# Full text.


@query(f"SELECT doc_id, list_filter({_words('text')}, lambda x: x IS NOT NULL) AS words FROM documents")
def tokenize(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.kept_tokens(F.col("text")).alias("words"))


@query(f"WITH {PLACES} SELECT path, any_value(title) AS title, count(*) FILTER (WHERE field = 'title')::INTEGER AS dl_title, count(*) FILTER (WHERE field = 'body')::INTEGER AS dl_body, count(*) FILTER (WHERE field = 'tags')::INTEGER AS dl_tags FROM places GROUP BY path")
def doc_lengths(spark, d):
    return fulltext.lengths(fulltext.documents(notes(spark, d)))


@query(f"WITH {PLACES} SELECT field, term, count(DISTINCT path) AS df FROM places GROUP BY field, term")
def term_df(spark, d):
    return fulltext.postings(fulltext.documents(notes(spark, d))).groupBy("field", "term").agg(F.count("*").alias("df"))


@query(f"WITH {PLACES} SELECT field, term, path, list(position::INTEGER ORDER BY position) AS positions FROM places GROUP BY field, term, path")
def postings(spark, d):
    return fulltext.postings(fulltext.documents(notes(spark, d))).drop("bucket")


def _search(spark, d, text, limit=20):
    return fulltext.search(fulltext.documents(notes(spark, d)), text, limit, DIGITS)


@query(f"WITH {_bm25([('body', w, 1.0) for w in WORDS.split()])} SELECT * FROM found")
def bm25_top_k(spark, d):
    return _search(spark, d, f"body:({WORDS})")


@query(f"WITH {_bm25(_fields(WORDS + ' en 12'))} SELECT * FROM found")
def bm25_multi_field(spark, d):
    return _search(spark, d, f"{WORDS} en 12")


@query(f"WITH {_bm25(_fields('from this'), 'list_contains(hit, ' + repr('body:from') + ') AND list_contains(hit, ' + repr('body:this') + ')')} SELECT * FROM found")
def fts_and(spark, d):
    return _search(spark, d, "from AND this")


@query(f"WITH {_bm25(_fields('from'), 'path NOT IN (SELECT path FROM places WHERE term = ' + repr('this') + ')')} SELECT * FROM found")
def fts_not(spark, d):
    return _search(spark, d, "from -this")


@query(f"WITH {_bm25([('tags', 'fr', 1.0), ('title', '6', 1.0)])} SELECT * FROM found")
def fts_field(spark, d):
    return _search(spark, d, "tags:fr title:6")


@query(f"WITH {_bm25([*_fields('from', 2.5), *_fields('une')])} SELECT * FROM found")
def fts_boost(spark, d):
    return _search(spark, d, "from^2.5 une")


@query(
    PLACES.join(["WITH ", ""])
    + """, pairs AS (SELECT a.path, any_value(a.title) AS title, count(*)::DOUBLE AS tf FROM places a JOIN places b ON a.path = b.path AND a.field = b.field AND b.position = a.position + 1
  WHERE a.field = 'body' AND a.term = 'of' AND b.term = 'the' GROUP BY a.path),
n AS (SELECT count(*) AS docs FROM notes), dl AS (SELECT path, count(*) AS dl FROM places WHERE field = 'body' GROUP BY path), mean AS (SELECT sum(dl) / (SELECT docs FROM n) AS mean FROM dl),
df AS (SELECT sum(ln(1 + (docs - df + 0.5E0) / (df + 0.5E0))) AS idf FROM (SELECT term, count(DISTINCT path) AS df FROM places WHERE field = 'body' AND term IN ('of', 'the') GROUP BY term) CROSS JOIN n)
SELECT path, title, round(idf * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * dl / mean)), 6) AS score FROM pairs JOIN dl USING (path) CROSS JOIN mean CROSS JOIN df ORDER BY score DESC, path LIMIT 20"""
)
def fts_phrase(spark, d):
    return _search(spark, d, 'body:"of the"')


@query(f"WITH {NOTES} SELECT path, title, 1.0::DOUBLE AS score FROM notes ORDER BY path LIMIT 20")
def fts_match_all_fallback(spark, d):
    return _search(spark, d, "?! (")


@query(f"WITH {PLACES} SELECT path, any_value(title) AS title, 1.0::DOUBLE AS score FROM places WHERE field = 'title' AND term >= '10' AND term < '2' GROUP BY path ORDER BY path LIMIT 20")
def fts_range(spark, d):
    return _search(spark, d, "title:[10 TO 2}")


@query(f"WITH {PLACES} SELECT path, any_value(title) AS title, 1.0::DOUBLE AS score FROM places WHERE field = 'tags' AND term IN ('fr', 'de') GROUP BY path ORDER BY path LIMIT 20")
def fts_set(spark, d):
    return _search(spark, d, "tags:IN [fr de]")


@query(f"WITH {NOTES}, n AS (SELECT count(*) AS docs FROM notes) SELECT path, title, round(ln(1 + (docs - 1 + 0.5E0) / 1.5E0), 6) AS score FROM notes, n WHERE path = 'src3/3.md'")
def fts_path(spark, d):
    return _search(spark, d, 'path:"src3/3.md"')


@query(f"WITH {_bm25(_fields(WORDS))} SELECT * FROM found")
def fts_index_search(spark, d):
    docs = fulltext.documents(notes(spark, d))
    return fulltext.search_index(fulltext.postings(docs), fulltext.lengths(docs), WORDS, 20, DIGITS)


# Vectors.


@query(f"WITH {SCORED} SELECT path, score FROM scored")
def cosine_scores(spark, d):
    return vectors.scored(note_vectors(spark, d), query_vector(spark, d), DIGITS).select("path", "score")


@query(f"WITH {SCORED} SELECT path, score FROM scored ORDER BY score DESC, path LIMIT 10")
def knn_top_k(spark, d):
    return vectors.knn(note_vectors(spark, d), query_vector(spark, d), 10, DIGITS).select("path", "score")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def knn_batch(spark, d):
    held = read(spark, d, "embeddings")
    queries = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.knn_batch(held, queries, 10, digits=DIGITS)


@query(f"WITH {SCORED} SELECT path, score FROM (SELECT * FROM scored ORDER BY score DESC, path LIMIT 50) WHERE path LIKE 'src1%'")
def semantic_folder_postfilter(spark, d):
    return vectors.semantic(note_vectors(spark, d), query_vector(spark, d), 50, folders=["src1"], digits=DIGITS).select("path", "score")


@query(f"WITH {SCORED} SELECT path, score FROM (SELECT * FROM scored ORDER BY score DESC, path LIMIT 50) WHERE tags = 'en'")
def semantic_tag_postfilter(spark, d):
    return vectors.semantic(note_vectors(spark, d), query_vector(spark, d), 50, tags=["en"], digits=DIGITS).select("path", "score")


@query(f"WITH {VECTORS} SELECT path, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM vectors WHERE path LIKE 'src2/%' ORDER BY score DESC, path LIMIT 10")
def semantic_prefilter(spark, d):
    return vectors.semantic(note_vectors(spark, d), query_vector(spark, d), 10, folders=["src2/"], prefilter=True, digits=DIGITS).select("path", "score")


# Fusion.


def _fused(limit: int) -> str:
    return f"""{_bm25(_fields(WORDS), limit=2 * limit).replace(NOTES, SCORED)}, sem AS (SELECT * FROM scored ORDER BY score DESC, path LIMIT {2 * limit}),
top AS (SELECT greatest(1.0::DOUBLE, coalesce(max(score), 0)) AS top FROM found),
fused AS (SELECT coalesce(s.path, f.path) AS path, coalesce(s.title, f.title) AS title, CASE WHEN s.path IS NULL THEN '[FTS match]' ELSE s.body END AS chunk,
  round(CASE WHEN s.path IS NOT NULL AND f.path IS NOT NULL THEN 0.7E0 * s.score + 0.3E0 * (f.score / top) WHEN s.path IS NOT NULL THEN s.score ELSE 0.3E0 * (f.score / top) END, 6) AS score,
  coalesce(s.start_line, 0)::INTEGER AS start_line, coalesce(s.end_line, 0)::INTEGER AS end_line, CASE WHEN s.path IS NULL THEN [] ELSE [s.tags] END AS tags, '' AS heading,
  CASE WHEN s.path IS NOT NULL AND f.path IS NOT NULL THEN 'hybrid' WHEN s.path IS NOT NULL THEN 'semantic' ELSE 'fts' END AS match_type
  FROM sem s FULL JOIN found f ON s.path = f.path CROSS JOIN top),
results AS (SELECT * FROM fused ORDER BY score DESC, path LIMIT {limit})"""


def _hybrid(spark, d, limit):
    near = vectors.semantic(note_vectors(spark, d), query_vector(spark, d), 2 * limit, digits=DIGITS)
    return hybrid.merge(near, hybrid.fts_results(_search(spark, d, WORDS, 2 * limit)), limit, Search(), DIGITS)


@query(f"WITH {_fused(10)} SELECT * FROM results")
def hybrid_top_k(spark, d):
    return _hybrid(spark, d, 10)


@query(f"WITH {_fused(40)} SELECT path, score, match_type FROM results")
def hybrid_merge(spark, d):
    return _hybrid(spark, d, 40).select("path", "score", "match_type")


@query(f"WITH {_fused(40)} SELECT path, score FROM results WHERE path NOT LIKE 'src1%' AND path NOT LIKE 'src2/%'")
def hybrid_exclude(spark, d):
    return hybrid.exclude(_hybrid(spark, d, 40), ["src1", "src2/"]).select("path", "score")


@query(f"WITH {_fused(40)} SELECT path, score FROM results WHERE score >= 0.28")
def hybrid_threshold(spark, d):
    return hybrid.threshold(_hybrid(spark, d, 40), 0.28).select("path", "score")


@query(f"WITH {_fused(40)} SELECT path, score FROM results WHERE path IN (SELECT n.path FROM notes n JOIN events e ON e.event_id = n.doc_id WHERE date_trunc('second', e.ts) >= TIMESTAMP '2024-01-02')")
def hybrid_since(spark, d):
    changed = read(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("modified"))
    dated = notes(spark, d).join(changed, "doc_id").select("path", "modified")
    return hybrid.since(_hybrid(spark, d, 40), dated, "2024-01-02").select("path", "score")


# Graph.


@query(f"WITH {LINKS} SELECT * FROM links WHERE source_path = 'conv/7-0.md'")
def outgoing_links(spark, d):
    return graph.outgoing(turn_links(spark, d), "conv/7-0.md")


@query(f"WITH {LINKS} SELECT * FROM links WHERE target_path = 'conv/3-0.md'")
def backlinks(spark, d):
    return graph.backlinks(turn_links(spark, d), "conv/3-0.md")


@query(f"WITH {LINKS} SELECT (SELECT count(*) FROM (SELECT source_path FROM links UNION SELECT target_path FROM links)) AS node_count, (SELECT count(*) FROM links) AS edge_count")
def graph_stats(spark, d):
    return graph.stats(turn_links(spark, d))


def _reach(start: str, step: str, depth: int) -> str:
    return f"walk AS (SELECT '{start}' AS path, 0 AS depth UNION ALL SELECT {step}, w.depth + 1 FROM walk w JOIN both_ways e ON e.here = w.path WHERE w.depth < {depth}), reached AS (SELECT path, min(depth) AS depth FROM walk GROUP BY path)"


@query(f"WITH RECURSIVE {LINKS}, {BOTH}, {_reach('conv/2-0.md', 'e.there', 1)} SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS title, depth FROM reached")
def expand_1(spark, d):
    return graph.expand_nodes(turn_links(spark, d), "conv/2-0.md", 1)


@query(f"WITH RECURSIVE {LINKS}, {BOTH}, {_reach('conv/2-0.md', 'e.there', 2)} SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS title, depth FROM reached")
def expand_2(spark, d):
    return graph.expand_nodes(turn_links(spark, d), "conv/2-0.md", 2)


@query(f"WITH RECURSIVE {LINKS}, {BOTH}, {_reach('conv/2-0.md', 'e.there', 1)} SELECT source_path, target_path, min(context) AS context FROM links WHERE source_path IN (SELECT path FROM reached) OR target_path IN (SELECT path FROM reached) GROUP BY source_path, target_path")
def expand_edges(spark, d):
    return graph.expand_edges(turn_links(spark, d), "conv/2-0.md", 2)


@query(f"WITH RECURSIVE {LINKS}, both_ways AS (SELECT target_path AS here, source_path AS there FROM links), {_reach('conv/1-0.md', 'e.there', 3)} SELECT path, depth FROM reached WHERE depth > 0")
def propagate(spark, d):
    return graph.propagate(turn_links(spark, d), "conv/1-0.md", 3)


@query(f"""WITH {LINKS}, {BOTH}, results AS (SELECT 'conv/' || conv_id || '-0.md' AS path, conv_id + 1 AS rank FROM conversations WHERE turn = 0 AND conv_id < 10),
near AS (SELECT there AS path, here AS related_to, rank FROM both_ways JOIN results ON path = here WHERE rank <= 5 AND there NOT IN (SELECT path FROM results))
SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS title, arg_min(related_to, rank) AS related_to FROM near GROUP BY path""")
def linked_notes(spark, d):
    top = read(spark, d, "conversations").where("turn = 0 AND conv_id < 10")
    results = top.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("-0.md")).alias("path"), (F.col("conv_id") + 1).alias("rank"))
    return graph.linked_notes(results, turn_links(spark, d))


@query(f"WITH {LINKS} SELECT * FROM links WHERE source_path NOT LIKE 'conv/1%' UNION SELECT 'conv/1-0.md', 'conv/9-0.md', 'new'")
def update_links_incremental(spark, d):
    old = turn_links(spark, d)
    sources = old.where(F.col("source_path").startswith("conv/1")).select(F.col("source_path").alias("path"))
    fresh = spark.range(2).select(F.lit("conv/1-0.md").alias("source_path"), F.lit("conv/9-0.md").alias("target_path"), F.lit("new").alias("context"))
    return graph.update_links(old, sources, fresh)


@query(f"WITH {LINKS} SELECT * FROM links WHERE source_path NOT LIKE 'conv/2-%'")
def remove_file_links(spark, d):
    old = turn_links(spark, d)
    return graph.remove_sources(old, old.where(F.col("source_path").startswith("conv/2-")).select(F.col("source_path").alias("path")))


# Index upkeep.


def _manifests(spark, d) -> tuple[DataFrame, DataFrame]:
    hashed = notes(spark, d).select("doc_id", "path", tx.content_hash(F.col("content")).alias("content_hash"))
    old = hashed.where("doc_id % 10 <> 0").withColumn("content_hash", F.when(F.expr("doc_id % 7 = 0"), "stale").otherwise(F.col("content_hash")))
    return old.drop("doc_id"), hashed.where("doc_id % 11 <> 0").drop("doc_id")


CHANGES = f"""{NOTES}, h AS (SELECT doc_id, path, sha256(body) AS hash FROM notes), changes AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN doc_id % 11 = 0 AND doc_id % 7 = 0 THEN 'stale' ELSE hash END AS content_hash FROM h WHERE NOT (doc_id % 10 = 0 AND doc_id % 11 = 0))"""


@query(f"WITH {CHANGES} SELECT * FROM changes")
def change_classification(spark, d):
    return index.classify(*_manifests(spark, d))


@query(f"WITH {CHANGES} SELECT count(*) FILTER (WHERE change <> 'deleted') AS total_files, count(*) FILTER (WHERE change IN ('new', 'changed')) AS indexed, count(*) FILTER (WHERE change = 'unchanged') AS skipped, count(*) FILTER (WHERE change = 'deleted') AS deleted FROM changes")
def index_stats(spark, d):
    return index.change_counts(index.classify(*_manifests(spark, d)))


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that all nodes share."""
    return f"{shared_folder(spark)}/quernel/index-{uuid.uuid4().hex}"


def _dated(spark, d) -> DataFrame:
    return markdown(spark, d).withColumn("modified", F.lit("2024-01-01").cast("timestamp"))


def _edited(base: DataFrame) -> DataFrame:
    """The notes after some went, some came, and some were changed."""
    more = F.when(F.col("conv_id") % 4 == 1, F.lit("\n## Added\nwords that are new\n")).otherwise("")
    return base.where("conv_id % 3 <> 0").withColumn("content", F.concat("content", more))


REFRESHED = f"""{MARKDOWN}, edited AS (SELECT conv_id, path, content || CASE WHEN conv_id % 4 = 1 THEN chr(10) || '## Added' || chr(10) || 'words that are new' || chr(10) ELSE '' END AS content FROM markdown WHERE conv_id % 3 <> 0)"""


def _refreshed(spark, d) -> index.Store:
    """A store after two refreshes; the second one finds new, changed and deleted notes."""
    store, settings = index.Store(spark, _scratch(spark)), Config(index=Index(max_chunk_tokens=100_000)).validated()
    base = _dated(spark, d)
    index.refresh(store, base.where("conv_id % 5 <> 0"), settings, HashingEmbedder())
    index.refresh(store, _edited(base), settings, HashingEmbedder())
    return store


@query(f"WITH {REFRESHED} SELECT path, sha256(content) AS content_hash FROM edited")
def incremental_refresh(spark, d):
    """The manifest after two refreshes."""
    return _refreshed(spark, d).table("manifest")


@query(f"""WITH {REFRESHED}, bodies AS (SELECT conv_id, path, string_split(content, chr(10) || '---' || chr(10))[2] AS body FROM edited),
w AS (SELECT path, list_filter({_words('body')}, lambda x: x IS NOT NULL) AS words, len(string_split(body, chr(10) || '## ')) AS chunks FROM bodies),
found AS (SELECT DISTINCT e.path AS source_path, 'conv/' || (c.conv_id + c.turn + 1) || '.md' AS target_path, c.turn AS turn FROM edited e JOIN conversations c USING (conv_id)),
l AS (SELECT source_path, count(*) AS n FROM found WHERE target_path IN (SELECT path FROM edited) GROUP BY source_path)
SELECT w.path, len(words)::BIGINT AS dl_body, len(words)::BIGINT AS places, len(list_distinct(words))::BIGINT AS terms, chunks::BIGINT AS chunks, coalesce(l.n, 0)::BIGINT AS links FROM w LEFT JOIN l ON l.source_path = w.path""")
def refresh_tables(spark, d):
    """What the postings, lengths, vectors and links hold of each note after two refreshes."""
    store = _refreshed(spark, d)
    body = store.table("postings").where("field = 'body'").groupBy("path").agg(F.sum(F.size("positions")).alias("places"), F.count("*").alias("terms"))
    held = store.table("vectors").groupBy("path").agg(F.count_if(F.size("embedding") == 64).alias("chunks"))
    out = store.table("links").groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("links"))
    rows = store.table("lengths").select("path", F.col("dl_body").cast("long").alias("dl_body")).join(body, "path", "left").join(held, "path", "full").join(out, "path", "full")
    return rows.select("path", "dl_body", "places", "terms", "chunks", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


@query(f"WITH {REFRESHED} SELECT path, sha256(content) AS content_hash FROM edited")
def watch_refresh(spark, d):
    """The manifest after a watcher's first refresh and a tick that finds the notes edited."""
    base, seen = _dated(spark, d), []
    engine = Engine(spark, "", Config().validated(), HashingEmbedder(), _scratch(spark))
    engine.scan = lambda: _edited(base) if engine.store.version() else base
    watcher = watching.watch(engine, _scratch(spark), "1 second", seen.append)
    while watcher.isActive and len(seen) < 2:
        watcher.awaitTermination(1)
    watcher.stop()
    return engine.store.table("manifest")


@query(f"""WITH {NOTES}, l AS (SELECT doc_id, path, 1 + doc_id % 7 AS a, 1 + doc_id % 7 + doc_id % 3 AS b, unnest(list_transform({LINES_OF.format('body')}, lambda x, i: {{'i': i, 'line': x}})) AS x FROM notes)
SELECT path, a::INTEGER AS start_line, x.i::INTEGER AS line_no, x.line AS line, x.i BETWEEN a AND b AS is_match FROM l WHERE x.i BETWEEN a - 2 AND b + 2""")
def context_window_lines(spark, d):
    held, first = notes(spark, d), F.col("doc_id") % 7 + 1
    return context_window(held.select("path", first.cast("int").alias("start_line"), (first + F.col("doc_id") % 3).cast("int").alias("end_line")), held, 2)


@query(f"""WITH w AS (SELECT conv_id || '-' || turn AS path, unnest(list_filter({_words('text')}, lambda x: x IS NOT NULL)) AS word FROM conversations),
h AS (SELECT path, CAST('0x' || substr(sha256(word), 1, 16) AS UBIGINT) AS h FROM w),
v AS (SELECT path, (h % 16)::INTEGER AS dim, sum(CASE WHEN h >= 9223372036854775808 THEN 1.0E0 ELSE -1.0E0 END) AS v FROM h GROUP BY ALL)
SELECT path, dim, round((v / sqrt(sum(v * v) OVER (PARTITION BY path)))::FLOAT::DOUBLE, 4) AS value FROM v QUALIFY v <> 0""")
def embed_hashing(spark, d):
    turns = read(spark, d, "conversations")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    made = turns.select(
        path.alias("path"), F.lit("t").alias("title"), F.lit("").alias("tags"), F.lit(None).cast("string").alias("heading"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "text", F.lit(0).alias("body_line_offset"),
    )
    held = embed_chunks(made, HashingEmbedder(16))
    each = held.select("path", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    return each.select("path", "dim", F.round(F.col("x").cast("double"), 4).alias("value"))


@query(f"WITH {PLACES} SELECT path, any_value(title) AS title, count(*)::DOUBLE AS matched FROM places WHERE field = 'body' AND starts_with(term, 'whi') GROUP BY path")
def fts_prefix_matches(spark, d):
    rows = fulltext.placed(fulltext.documents(notes(spark, d)), parse('body:"whi"*'))
    return rows.where(F.size("p0") > 0).select("path", "title", F.size("p0").cast("double").alias("matched"))
