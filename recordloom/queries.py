"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions import decompose as D
from recordloom.functions import similarity as S
from recordloom.functions import text as T
from recordloom.functions.terms import hits_of_table
from recordloom.operators import audit as A
from recordloom.operators import chapters as C
from recordloom.operators import match as M
from recordloom.operators import results as R
from recordloom.operators import review as V
from recordloom.operators.fuzzy import distance_allows, overlapping
from recordloom.operators.search import labelled, search
from recordloom.vocab import DEFAULT, spellings

#: Source and matched names of the inline fixture (row_id, source, match in the first catalog, match in the second, scores).
PAIRS = [
    (1, "Chăm sóc ống thông bàng quang", "Mở thông bàng quang", "Chăm sóc ống dẫn lưu", 71.0, 90.0),
    (2, "Phẫu thuật nội soi cắt ruột thừa", "Phẫu thuật mo mo cắt ruột thừa", "Phẫu thuật nội soi cắt ruột thừa", 82.5, 100.0),
    (3, "Xét nghiệm máu lắng", "Xét nghiệm nước tiểu", "", 75.0, 0.0),
    (4, "Chụp x quang một bên", "Chụp x quang hai bên", "Chụp x quang cả hai bên", 91.0, 88.0),
    (5, "Khâu vết rách có biến chứng", "Khâu vết rách không biến chứng", "Khâu vết rách", 93.0, 77.9),
    (6, "Chọc dò dưới hướng dẫn của siêu âm", "Chọc dò", "Chọc dò dưới clvt", 60.0, 79.0),
    (7, "Tập vận động 1 lần", "Tập vận động nhiều lần", "Tập vận động", 85.0, 85.0),
    (8, "Đo chức năng hô hấp", "Đo chức năng hô hấp", "đo chức năng hô hấp ", 100.0, 100.0),
    (9, "Phẫu thuật mở thông dạ dày", "Thay băng", "Rút ống thông", 40.0, 41.0),
    (10, "Nội soi hai bên", "Nội soi một bên", "Phẫu thuật mở", 78.0, 77.0),
    (11, "Thay băng vết mổ", "Phẫu thuật cắt lọc", "Định lượng glucose", 50.0, 55.5),
    (12, "Siêu âm ổ bụng", "Siêu âm tim", "Siêu âm thai", 77.9, 78.0),
    (13, "", "Siêu âm tim", "", 0.0, 0.0),
]
#: Names as a catalog spells them (id, name).
NAMES = [
    (1, "PT nội soi cắt TLT"), (2, "SA ổ bụng"), (3, "Phẫu thuật sa tử cung"), (4, "Chụp CT/MRI sọ não"), (5, "Đặt NKQ"), (6, "Khâu phục hồi rách âm hộ"), (7, "Khâu phục hồi bờ mi"), (8, "Mổ đẻ lần 2"), (9, "CS vết thương"),
    (10, "Đo đường huyết mao mạch tại giường"), (11, "Tiêm khớp gối"), (12, "Cắt gan gan toàn bộ"), (13, "Phẫu thuật phẫu thuật lấy thai đường bụng"), (14, "***"), (15, "Tập vận động khớp háng"), (16, "Chụp cắt lớp vi tính gan"),
]
ROMANS = [(1, "I"), (2, "IV"), (3, "IX"), (4, "XIV"), (5, "MCMXCIV"), (6, "xlii"), (7, ""), (8, "Q")]
ORDINALS = [(1, "1"), (2, "1.0"), (3, "1.5"), (4, "0"), (5, "-1"), (6, "TT"), (7, ""), (8, " 12 "), (9, "007"), (10, "a\nb")]
SPECIALTIES = [(1, "I. Nội khoa > Tim mạch"), (2, "I. Nội khoa > Tim mạch"), (3, "I. Nội khoa"), (4, " II. Ngoại khoa > Tiêu hóa"), (5, "Tim mạch"), (6, ""), (7, None), (8, "IX. Mắt")]


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts by type and name (id, name)."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("name"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts by parity as sources (q, name) and targets (idx, code, name); larger sources are spelled in another way, with their size."""
    p = _table(spark, sf_dir, "part")
    other = F.concat_ws(" ", "p_name", F.concat(F.lit("("), "p_type", F.lit("), size")), F.col("p_size").cast("string"))
    src = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("q"), F.when(F.col("p_size") <= 10, F.concat_ws(" ", "p_type", "p_name")).otherwise(other).alias("name"))
    return src, p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("idx"), F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("code"), F.concat_ws(" ", "p_type", "p_name").alias("name"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of parts (idx, code, name), numbered in their order."""
    names = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("idx"))
    return names.select("idx", F.concat(F.lit("P"), F.col("idx").cast("string")).alias("code"), F.col("p_name").alias("name"))


#: What the words of a part's type and name stand for, so that every part has a procedure's name: type, second word, first word.
ACTS = {"STANDARD": "Chăm sóc", "MEDIUM": "Phẫu thuật nội soi cắt", "PROMO": "Xét nghiệm", "LARGE": "Chụp x quang", "SMALL": "Khâu vết rách", "ECONOMY": "Phẫu thuật mo mo"}
ORGANS = {"plate": "ống thông bàng quang", "rod": "mở thông dạ dày", "ring": "tử cung", "bolt": "khớp gối", "gear": "máu", "gizmo": "nước tiểu", "anvil": "gan", "widget": "bờ mi"}
WAYS = {"small": "một bên", "blue": "hai bên", "cold": "có biến chứng", "new": "1 lần", "large": "nhiều lần", "red": "dưới hướng dẫn của siêu âm", "hot": "không biến chứng", "old": "tại giường"}


def _procedures_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as procedures (id, name, size)."""
    said = lambda table, c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), c)
    words = F.split("p_name", " ")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", said(ACTS, F.col("p_type")), said(ORGANS, words[1]), said(WAYS, words[0])).alias("name"), F.col("p_size").alias("size"))


def _procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as procedures (id, name), and the inline names under negative ids."""
    return _procedures_of_parts(spark, sf_dir).drop("size").unionByName(spark.createDataFrame([(-i, n) for i, n in NAMES], "id long, name string"))


LITE_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[*+\-,.\[\]():;/\\_\"''`~!?@#$%^&=]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS_SQL = "CASE WHEN len(list_filter(string_split({0}, ' '), lambda t: length(t) >= 2)) > 0 THEN list_filter(string_split({0}, ' '), lambda t: length(t) >= 2) ELSE list_filter(string_split({0}, ' '), lambda t: t <> '') END"
_said_sql = lambda table, c: "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + f"}}[{c}], {c})"
_PROC_SQL = f"""proc AS (SELECT p_partkey AS id, {_said_sql(ACTS, "p_type")} || ' ' || {_said_sql(ORGANS, "string_split(p_name, ' ')[2]")} || ' ' || {_said_sql(WAYS, "string_split(p_name, ' ')[1]")} AS name FROM part
  UNION ALL SELECT -id, name FROM {_values(NAMES)} v(id, name))"""
_LOWER_SQL = f"{_PROC_SQL}, lowered AS (SELECT id::BIGINT AS id, lower(name) AS clean FROM proc)"
_NAMES_SQL = "names AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS name FROM part)"
_HALVES_SQL = f"""src AS (SELECT q, name, {LITE_SQL.format("name")} AS clean FROM (SELECT p_partkey AS q, CASE WHEN p_size <= 10 THEN p_type || ' ' || p_name ELSE p_name || ' (' || p_type || '), size ' || p_size END AS name FROM part WHERE p_partkey % 2 = 0)),
tgt AS (SELECT id AS idx, name, {LITE_SQL.format("name")} AS clean FROM (SELECT p_partkey AS id, p_type || ' ' || p_name AS name FROM part WHERE p_partkey % 2 = 1))"""
_CANDIDATES_SQL = f"""{_HALVES_SQL},
exact AS (SELECT q, min(idx) AS idx FROM src JOIN tgt ON tgt.clean = src.clean AND src.clean <> '' GROUP BY q),
rest AS (SELECT * FROM src WHERE q NOT IN (SELECT q FROM exact)),
probes AS (SELECT q, unnest({TOKENS_SQL.format("clean")}) AS token, unnest(range(len({TOKENS_SQL.format("clean")}))) AS pos FROM rest),
merged AS (SELECT q, token, count(*) AS w, min(pos) AS pos FROM probes GROUP BY q, token),
post AS (SELECT DISTINCT idx, unnest({TOKENS_SQL.format("clean")}) AS token FROM tgt),
cand AS (SELECT q, idx, sum(w) AS weight, min(pos) AS pos FROM merged JOIN post USING (token) GROUP BY q, idx),
ranked AS (SELECT q, idx, weight, row_number() OVER (PARTITION BY q ORDER BY weight DESC, pos, idx) AS rank FROM cand QUALIFY rank <= {M.TOP})"""
#: The least sequence ratio of fuzzy_pairs.
SIMILAR = 0.85
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_NAMES_SQL} SELECT id, {LITE_SQL.format('name')} AS clean FROM names")
def clean_text_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", T.clean_lite(F.col("name")).alias("clean"))


@query(f"WITH {_NAMES_SQL} SELECT id, trim(regexp_replace(replace(strip_accents(lower(name)), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS keyword FROM names")
def unaccent_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", T.keyword(F.col("name")).alias("keyword"))


@query(f"WITH {_NAMES_SQL} SELECT id, array_to_string({TOKENS_SQL.format('clean')}, '|') AS tokens FROM (SELECT id, {LITE_SQL.format('name')} AS clean FROM names)")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _names(spark, sf_dir).select("id", T.clean_lite(F.col("name")).alias("clean"))
    return clean.select("id", F.array_join(T.tokens(F.col("clean")), "|").alias("tokens"))


@query()
def clean_text_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _procedures(spark, sf_dir).select("id", T.normalize(F.col("name"), DEFAULT).alias("clean"))


@query(f"SELECT p_partkey AS id, p_size::BIGINT AS value FROM part UNION ALL SELECT -id, value FROM {_values([(i, v) for (i, _), v in zip(ROMANS, (1, 4, 9, 14, 1994, 42, 0, 0), strict=True)])} v(id, value)")
def roman_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of parts' sizes (1 to 50) spelled as numerals, in either case; and of the inline ones."""
    size = F.col("p_size")
    tens, ones = (F.array(*map(F.lit, x.split(","))) for x in (",X,XX,XXX,XL,L", ",I,II,III,IV,V,VI,VII,VIII,IX"))
    spelled = F.concat(F.get(tens, F.floor(size / 10).cast("int")), F.get(ones, (size % 10).cast("int")))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, spelled).otherwise(F.lower(spelled)).alias("r"))
    every = parts.unionByName(spark.createDataFrame([(-i, r) for i, r in ROMANS], "id long, r string"))
    return every.select("id", T.roman_value(F.col("r")).cast("long").alias("value"))


_ORDINALS_SQL = f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.0' WHEN 2 THEN p_size || '.5 ' WHEN 3 THEN '-' || p_size ELSE p_name || chr(10) || p_size END FROM part UNION ALL SELECT -id, t FROM {_values(ORDINALS)} o(id, t)"""


@query(rf"SELECT id::BIGINT AS id, CASE WHEN regexp_full_match(trim(t), '\d+(\.0+)?') THEN (trim(t)::DOUBLE::BIGINT)::VARCHAR ELSE trim(regexp_replace(trim(t), '[\r\n]+', ' ', 'g')) END AS shown, regexp_full_match(trim(t), '\d+(\.\d+)?') AND try_cast(trim(t) AS DOUBLE) > 0 AS numeric FROM ({_ORDINALS_SQL}) v(id, t)")
def parse_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of parts as cells of a catalog's first column, in five spellings; and the inline ones."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    cell = F.when(k % 5 == 0, size).when(k % 5 == 1, F.concat(size, F.lit(".0"))).when(k % 5 == 2, F.concat(size, F.lit(".5 "))).when(k % 5 == 3, F.concat(F.lit("-"), size)).otherwise(F.concat("p_name", F.lit("\n"), size))
    cells = _table(spark, sf_dir, "part").select(k.alias("id"), cell.alias("t")).unionByName(spark.createDataFrame([(-i, t) for i, t in ORDINALS], "id long, t string"))
    return cells.select("id", T.parse_ordinal(F.col("t")).alias("shown"), T.is_ordinal(F.col("t")).alias("numeric"))


@query(f"WITH {_HALVES_SQL} SELECT q, coalesce(min(idx), -1) AS idx FROM src LEFT JOIN tgt ON tgt.clean = src.clean AND src.clean <> '' GROUP BY q")
def exact_link_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt = _halves(spark, sf_dir)
    a, b = M.prepared(src), M.prepared(tgt)
    return a.select("q").join(M.exact_link(a, b), "q", "left").select("q", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query(f"WITH {_NAMES_SQL} SELECT min(id) AS id, clean FROM (SELECT id, {LITE_SQL.format('name')} AS clean FROM names) GROUP BY clean")
def target_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _names(spark, sf_dir).select("id", T.clean_lite(F.col("name")).alias("clean"))
    return M.dedupe_first(clean, order="id")


@query(f"WITH {_HALVES_SQL} SELECT DISTINCT idx, unnest({TOKENS_SQL.format('clean')}) AS token FROM tgt")
def inverted_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.postings(M.prepared(_halves(spark, sf_dir)[1]), tags=False)


def _texts(spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """The whole texts of all documents (key, name)."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias(key), F.col("text").alias("name"))


_TEXTS_SQL = f"texts AS (SELECT doc_id, {LITE_SQL.format('text')} AS clean FROM documents)"


@query(f"WITH {_TEXTS_SQL} SELECT doc_id, clean FROM texts")
def text_clean_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.clean_lite(F.col("name")).alias("clean"))


@query("SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS keyword FROM documents")
def text_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.keyword(F.col("name")).alias("keyword"))


@query(f"WITH {_TEXTS_SQL} SELECT doc_id, array_to_string({TOKENS_SQL.format('clean')}, '|') AS tokens FROM texts")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _texts(spark, sf_dir).select("doc_id", T.clean_lite(F.col("name")).alias("clean"))
    return clean.select("doc_id", F.array_join(T.tokens(F.col("clean")), "|").alias("tokens"))


_PHRASES_SQL = "list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2])"


@query(f"""WITH {_TEXTS_SQL}, items AS (SELECT item_id, string_split({LITE_SQL.format("text")}, ' ') AS w FROM benchmark),
terms AS (SELECT phrase, min(item_id) AS rank FROM (SELECT item_id, unnest({_PHRASES_SQL.format("w")}) AS phrase FROM items) GROUP BY phrase),
said AS (SELECT DISTINCT doc_id, unnest({_PHRASES_SQL.format("string_split(clean, ' ')")}) AS phrase FROM texts),
met AS (SELECT doc_id, count(*) AS n, string_agg(phrase, '|' ORDER BY rank, phrase) AS phrases FROM said JOIN terms USING (phrase) GROUP BY doc_id)
SELECT texts.doc_id, coalesce(n, 0)::BIGINT AS n_terms, coalesce(phrases, '') AS terms FROM texts LEFT JOIN met USING (doc_id)""")
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a site's table, here all phrases of three words of the benchmark, in the whole texts of all documents."""
    words = F.split(T.clean_lite(F.col("text")), " ")
    items = _table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    three = F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i <= F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    terms = items.select("item_id", F.explode(three).alias("phrase")).groupBy("phrase").agg(F.min("item_id").alias("rank")).withColumn("kind", F.lit("item"))
    clean = _texts(spark, sf_dir).select("doc_id", T.clean_lite(F.col("name")).alias("clean"))
    found = hits_of_table(clean, terms, "doc_id", "clean")
    return found.select("doc_id", F.size("found").cast("long").alias("n_terms"), F.array_join("found.phrase", "|").alias("terms"))


@query(f"WITH {_TEXTS_SQL} SELECT min(doc_id) AS doc_id, clean FROM texts GROUP BY clean")
def text_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedupe_first(_texts(spark, sf_dir).select("doc_id", T.clean_lite(F.col("name")).alias("clean")), order="doc_id")


@query(f"WITH {_TEXTS_SQL} SELECT s.doc_id AS q, coalesce(min(t.doc_id), -1) AS idx FROM texts s LEFT JOIN texts t ON t.doc_id % 2 = 1 AND t.clean = s.clean AND s.clean <> '' WHERE s.doc_id % 2 = 0 GROUP BY s.doc_id")
def text_exact_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = M.prepared(_texts(spark, sf_dir, "q").filter("q % 2 = 0")), M.prepared(_texts(spark, sf_dir, "idx").filter("idx % 2 = 1"))
    return a.select("q").join(M.exact_link(a, b), "q", "left").select("q", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query(f"WITH {_TEXTS_SQL} SELECT DISTINCT doc_id AS idx, unnest({TOKENS_SQL.format('clean')}) AS token FROM texts")
def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.postings(M.prepared(_texts(spark, sf_dir, "idx")), tags=False)


@query(f"WITH {_CANDIDATES_SQL} SELECT q, idx, weight::BIGINT AS weight, rank::BIGINT AS rank FROM ranked")
def candidate_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt = _halves(spark, sf_dir)
    a, b = M.prepared(src), M.prepared(tgt)
    left = a.join(M.exact_link(a, b), "q", "left_anti")
    asked = M.distinct_names(left, "q")
    near = M.candidates(asked, M.postings(M.distinct_names(b, "idx"), False), False, members=M.members_of(b))
    met = left.select("q", "clean").join(asked.select("clean", F.col("q").alias("__q")), "clean").join(near.withColumnRenamed("q", "__q"), "__q")
    return met.select("q", "idx", F.col("weight").cast("long").alias("weight"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_HALVES_SQL} SELECT q, idx, row_number() OVER (PARTITION BY q ORDER BY idx)::BIGINT AS rank FROM src JOIN tgt ON length(src.clean) > 0 AND abs(length(src.clean) - length(tgt.clean)) / greatest(length(src.clean), length(tgt.clean)) <= {M.BAND} QUALIFY rank <= {M.FALLBACK}")
def length_band_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt = _halves(spark, sf_dir)
    return M.length_band(M.prepared(src), M.prepared(tgt)).withColumn("rank", F.col("rank").cast("long"))


_PARTS_SQL = "parts AS (SELECT p_name AS name, min(p_partkey) AS idx FROM part GROUP BY p_name)"


@query(f"WITH {_PARTS_SQL} SELECT a.idx AS a, b.idx AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS ratio FROM parts a JOIN parts b ON a.idx < b.idx WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.5")
def levenshtein_ratio_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near_parts(spark, sf_dir, 0.5).filter("a < b")
    return pairs.select("a", "b", F.round(S.levenshtein_ratio(F.col("name_a"), F.col("name_b")), 6).alias("ratio")).filter("ratio >= 0.5")


def _near_parts(spark: SparkSession, sf_dir: str, band: float) -> DataFrame:
    """(a, b, name_a, name_b): pairs of distinct names whose lengths are within the band, joined by length."""
    p = _parts(spark, sf_dir).select("idx", "name", F.length("name").alias("n"))
    near = p.select(F.col("idx").alias("a"), F.col("name").alias("name_a"), F.explode(S.lengths_within(F.col("n"), band)).alias("n"))
    return near.join(p.select(F.col("idx").alias("b"), F.col("name").alias("name_b"), "n"), "n")


@query(f"WITH {_PARTS_SQL} SELECT a.idx AS idx, count(*)::BIGINT AS n FROM parts a JOIN parts b ON abs(length(a.name) - length(b.name)) / greatest(length(a.name), length(b.name)) <= 0.5 GROUP BY a.idx")
def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each passes the gate with: by lengths, no pairs."""
    p = _parts(spark, sf_dir).withColumn("length", F.length("name"))
    counted = p.groupBy("length").agg(F.count("*").alias("n"))
    passing = counted.select("length", F.explode(S.lengths_within(F.col("length"), S.gate_band(0.7))).alias("other")).join(counted.select(F.col("length").alias("other"), "n"), "other").groupBy("length").agg(F.sum("n").alias("n"))
    return p.join(passing, "length").select("idx", "n")


@query()
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near_parts(spark, sf_dir, S.gate_band(0.9)).filter("a < b")
    return pairs.select("a", "b", F.round(S.sequence_ratio(F.col("name_a"), F.col("name_b")), 6).alias("ratio"))


_LEV_SQL = "CASE WHEN 1 - levenshtein(a.clean, b.clean) / greatest(length(a.clean), length(b.clean)) >= {0} THEN 1 - levenshtein(a.clean, b.clean) / greatest(length(a.clean), length(b.clean)) ELSE 0 END"


@query(f"""WITH n AS (SELECT {LITE_SQL.format("p_type || ' ' || p_name")} AS clean, p_partkey AS q FROM part),
src AS (SELECT q, clean FROM n WHERE q % 2 = 0), tgt AS (SELECT min(q) AS idx, clean FROM n WHERE q % 2 = 1 GROUP BY clean),
best AS (SELECT src.q, tgt.idx FROM src LEFT JOIN tgt ON tgt.clean = src.clean) SELECT q, coalesce(idx, -1) AS idx FROM best""")
def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of even key linked to the first part of odd key whose cleaned type and name are equal."""
    n = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    a, b = M.prepared(n.filter("k % 2 = 0").withColumnRenamed("k", "q")), M.prepared(n.filter("k % 2 = 1").withColumnRenamed("k", "idx"))
    return a.select("q").join(M.exact_link(a, b), "q", "left").select("q", F.coalesce("idx", F.lit(-1)).alias("idx"))


_BEST_SQL = f"""WITH {_CANDIDATES_SQL},
alone AS (SELECT * FROM rest WHERE q NOT IN (SELECT q FROM ranked)),
band AS (SELECT q, idx, row_number() OVER (PARTITION BY q ORDER BY idx) AS rank FROM alone JOIN tgt ON length(alone.clean) > 0 AND abs(length(alone.clean) - length(tgt.clean)) / greatest(length(alone.clean), length(tgt.clean)) <= {M.BAND} QUALIFY rank <= {M.FALLBACK}),
pairs AS (SELECT q, idx, rank FROM ranked UNION ALL SELECT * FROM band),
gated AS (SELECT pairs.q, pairs.idx, rank, {_LEV_SQL.format(0.35)} AS f, length(a.clean) >= 3 AND length(b.clean) >= 3 AS cores, {_LEV_SQL.format(0.25)} AS core FROM pairs JOIN rest a ON a.q = pairs.q JOIN tgt b ON b.idx = pairs.idx
  WHERE abs(length(a.clean) - length(b.clean)) / greatest(length(a.clean), length(b.clean)) <= 0.5),
scored AS (SELECT q, idx, rank, least(f * 0.50 + f * 0.25 + CASE WHEN cores THEN core ELSE 1.0 END * 0.25, 1.0) AS s FROM gated WHERE NOT cores OR core >= 0.35),
won AS (SELECT q, idx, s FROM scored WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s >= 0.98 DESC, CASE WHEN s >= 0.98 THEN rank END ASC NULLS LAST, s DESC, rank) = 1),
found AS (SELECT q, idx, 1.0 AS s FROM exact UNION ALL SELECT * FROM won WHERE s >= 0.6)
SELECT src.q, coalesce('D' || idx, '') AS match_code, coalesce(floor(s * 1000 + 0.5) / 10, 0)::DOUBLE AS match_score FROM src LEFT JOIN found ON found.q = src.q"""


@query(_BEST_SQL)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every source name linked to its best target, or unmatched, by edit distance."""
    src, tgt = _halves(spark, sf_dir)
    return M.link(src, tgt, threshold=0.6, sequences=False).select("q", "match_code", "match_score")


@query(f"""WITH {_HALVES_SQL},
gated AS (SELECT q, idx, {_LEV_SQL.format(0.35)} AS f, length(a.clean) >= 3 AND length(b.clean) >= 3 AS cores, {_LEV_SQL.format(0.25)} AS core FROM src a JOIN tgt b ON abs(length(a.clean) - length(b.clean)) / greatest(length(a.clean), length(b.clean)) <= 0.5),
scored AS (SELECT q, idx, least(f * 0.50 + f * 0.25 + CASE WHEN cores THEN core ELSE 1.0 END * 0.25, 1.0) AS s FROM gated WHERE NOT cores OR core >= 0.35)
SELECT q, idx, round(s, 6)::DOUBLE AS score FROM scored WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s >= 0.98 DESC, CASE WHEN s >= 0.98 THEN idx END ASC NULLS LAST, s DESC, idx) = 1""")
def best_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best target of every source among all, by edit distance: what the candidates stand in for."""
    src, tgt = _halves(spark, sf_dir)
    return M.best_exhaustive(src, tgt, threshold=0.6, sequences=False).select("q", "idx", F.round("score", 6).alias("score"))


@query()
def search_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct first words of procedures searched in all of them, with the labels of what is found."""
    items = _procedures(spark, sf_dir).select(F.col("id").alias("idx"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("code"), "name")
    asked = items.select(F.substring_index("name", " ", 3).alias("query")).distinct().select(F.xxhash64("query").alias("query_id"), "query")
    return labelled(search(asked, items, vocab=DEFAULT), DEFAULT).select("query_id", "rank", "idx", "score", "match_type", "specialty_label", "anatomy_label")


def _catalog_sql(k: int, size: str) -> str:
    one = _BEST_SQL.replace("FROM part WHERE p_partkey % 2 = 1", f"FROM part WHERE p_partkey % 2 = 1 AND {size}")
    return f"SELECT q, {k} AS catalog, match_code, match_score FROM ({one})"


@query(f"{_catalog_sql(1, 'p_size <= 25')} UNION ALL {_catalog_sql(2, 'p_size > 25')}")
def link_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source name linked to two catalogs at once, parts of smaller and of larger size, by edit distance."""
    src, tgt = _halves(spark, sf_dir)
    sized = tgt.join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.when(F.col("p_size") <= 25, 1).otherwise(2).alias("catalog")), "idx")
    return M.link_stacked(src, sized, [1, 2], threshold=0.6, sequences=False).select("q", "catalog", "match_code", "match_score")


@query()
def best_match_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the sequence ratio as well."""
    src, tgt = _halves(spark, sf_dir)
    return M.link(src, tgt, threshold=0.6).select("q", "match_code", "match_score")


@query()
def link_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of even parts linked to those of odd ones under the whole vocabulary: tags, barriers, composite score."""
    return M.link(*_procedure_halves(spark, sf_dir), DEFAULT, threshold=0.5)


def _procedure_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Procedures by parity as sources (q, name), told apart by their size, and targets (idx, code, name, size)."""
    p = _procedures_of_parts(spark, sf_dir)
    src = p.filter("id % 2 = 0").select(F.col("id").alias("q"), F.concat_ws(" ", F.lit("Kỹ thuật"), "name", (F.col("size") % 4).cast("string")).alias("name"))
    return src, p.filter("id % 2 = 1").select(F.col("id").alias("idx"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("code"), "name", "size")


@query()
def link_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names linked under the light profile."""
    src, tgt = _halves(spark, sf_dir)
    return M.link_lite(src, tgt, DEFAULT, 0.6).select("q", "match_code", "match_score")


@query()
def link_two_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures linked to two catalogs, of smaller and of larger parts, in one pass; both links audited, combined."""
    src, tgt = _procedure_halves(spark, sf_dir)
    linked = M.link_catalogs(src, tgt.filter("size <= 25"), tgt.filter("size > 25"), DEFAULT, 0.6)
    both = A.audit_pair(A.audit_pair(linked, "name", "name_1", "score_1", "a"), "name", "name_2", "score_2", "b")
    return A.audit_row(both, "a", "b").select("q", "code_1", "score_1", "code_2", "score_2", "audit.severity", "audit.flag")


_CATS = list(DEFAULT.ontology)


def _has_sql(c: str, terms: list[str]) -> str:
    return " OR ".join(f"contains(' ' || {c} || ' ', ' {t} ')" for t in terms)


_ANAT_SQL = "list_distinct(list_concat(" + ", ".join("list_filter([" + ", ".join(f"'{t}'" for t in DEFAULT.terms(c)) + "], lambda t: contains(' ' || clean || ' ', ' ' || t || ' '))" for c in _CATS) + "))"
_CAT_SQL = "CASE " + " ".join(f"WHEN {_has_sql('clean', DEFAULT.terms(c))} THEN '{c}'" for c in _CATS) + " END"


def _lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _procedures(spark, sf_dir).select("id", F.lower("name").alias("clean"))


@query(f"WITH {_LOWER_SQL} SELECT id, array_to_string(list_sort({_ANAT_SQL}), '|') AS anatomy, coalesce({_CAT_SQL}, '') AS category, array_to_string(list_filter([{', '.join(repr(m) for m in spellings(DEFAULT.modifiers))}], lambda m: contains(' ' || clean || ' ', ' ' || m || ' ')), '|') AS modifiers FROM lowered")
def decompose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.decompose(_lowered(spark, sf_dir), "clean", DEFAULT)
    return rows.select("id", F.array_join(F.array_sort("anatomy"), "|").alias("anatomy"), F.coalesce("category", F.lit("")).alias("category"), F.array_join("modifiers", "|").alias("modifiers"))


@query()
def decompose_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.decompose(_procedures(spark, sf_dir).withColumn("clean", T.normalize(F.col("name"), DEFAULT)), "clean", DEFAULT)
    return rows.select("id", "clean", F.array_join("actions", "|").alias("actions"), F.array_join("modalities", "|").alias("modalities"), F.coalesce("modality", F.lit("")).alias("modality"), "rest", "core")


#: All orders as pairs of procedures (row_id, name, name_1, name_2, score_1, score_2): those of the parts of their first three lines, and the inline pairs under negative ids.
_PAIRS_SQL = f"""{_PROC_SQL},
lines AS (SELECT l_orderkey, min(l_partkey) FILTER (l_linenumber = 1) AS k0, min(l_partkey) FILTER (l_linenumber = 2) AS k1, min(l_partkey) FILTER (l_linenumber = 3) AS k2, min(l_quantity) FILTER (l_linenumber = 2) AS q1, min(l_quantity) FILTER (l_linenumber = 3) AS q2 FROM lineitem GROUP BY l_orderkey),
pairs AS (SELECT o_orderkey AS row_id, coalesce(a.name, '') AS name, coalesce(b.name, '') AS name_1, coalesce(c.name, '') AS name_2, coalesce(q1 + 50, 0)::DOUBLE AS score_1, coalesce(q2 + 50, 0)::DOUBLE AS score_2
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey LEFT JOIN proc a ON a.id = k0 LEFT JOIN proc b ON b.id = k1 LEFT JOIN proc c ON c.id = k2
  UNION ALL SELECT -row_id::BIGINT, name, name_1, name_2, score_1, score_2 FROM {_values(PAIRS)} v(row_id, name, name_1, name_2, score_1, score_2))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same."""
    at = lambda n, c: F.min(F.when(F.col("l_linenumber") == n, F.col(c)))
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(*(at(n + 1, "l_partkey").alias(f"k{n}") for n in range(3)), *(at(n + 1, "l_quantity").alias(f"q{n}") for n in (1, 2)))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")).join(lines, "row_id", "left")
    for n, name in enumerate(("name", "name_1", "name_2")):
        rows = rows.join(_procedures(spark, sf_dir).select(F.col("id").alias(f"k{n}"), F.col("name").alias(name)), f"k{n}", "left").fillna("", [name])
    score = lambda n: F.coalesce(F.col(f"q{n}") + 50, F.lit(0)).cast("double").alias(f"score_{n}")
    inline = spark.createDataFrame([(-r[0], *r[1:]) for r in PAIRS], "row_id long, name string, name_1 string, name_2 string, score_1 double, score_2 double")
    return rows.select("row_id", "name", "name_1", "name_2", score(1), score(2)).unionByName(inline)


@query(f"""WITH {_PAIRS_SQL}, parted AS (SELECT name, {_ANAT_SQL} AS terms, {_CAT_SQL} AS cat FROM (SELECT DISTINCT name, lower(name) AS clean FROM (SELECT name FROM pairs UNION ALL SELECT name_1 FROM pairs))),
n AS (SELECT row_id, a.terms AS x, b.terms AS y, a.cat AS xc, b.cat AS yc FROM pairs JOIN parted a ON a.name = pairs.name JOIN parted b ON b.name = pairs.name_1)
SELECT row_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 'GENERIC' WHEN len(list_filter(x, lambda s: len(list_filter(y, lambda t: contains(s, t) OR contains(t, s))) > 0)) > 0 THEN 'EXACT_MATCH' WHEN xc = yc THEN 'SAME_ORGAN_SYSTEM' ELSE 'SEVERE_CONFLICT' END AS status FROM n""")
def anatomy_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organs of each order's first two procedures against each other."""
    pairs = _pairs(spark, sf_dir).select("row_id", "name", "name_1")
    names = pairs.select("name").union(pairs.select("name_1")).distinct().withColumn("clean", F.lower("name"))
    parted = D.decompose(names, "clean", DEFAULT).select("name", "anatomy", "category")
    side = lambda tag, on: parted.select(F.col("name").alias(on), F.col("anatomy").alias(f"{tag}_anatomy"), F.col("category").alias(f"{tag}_category"))
    both = pairs.join(side("x", "name"), "name").join(side("y", "name_1"), "name_1")
    return both.select("row_id", D.anatomy_status(F.col("x_anatomy"), F.col("y_anatomy"), F.col("x_category"), F.col("y_category")).alias("status"))


_MODS = list(DEFAULT.modalities)
_MOD_SQL = "[" + ", ".join(f"'{m}'" for m in _MODS) + "][{0} % " + str(len(_MODS) + 1) + " + 1]"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MOD_SQL.format("l_partkey")} AS a, {_MOD_SQL.format("l_suppkey")} AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a IS NULL OR b IS NULL THEN 'UNKNOWN' WHEN a = b THEN 'MATCH' WHEN (least(a, b), greatest(a, b)) IN ({', '.join(str(tuple(sorted(c))) for c in DEFAULT.conflicts)}) THEN 'CONFLICT' ELSE 'COMPATIBLE' END AS status FROM m""")
def modality_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part and supplier stand for kinds of procedure, or for none, by their keys."""
    kind = lambda c: F.get(F.array(*map(F.lit, _MODS)), (F.col(c) % (len(_MODS) + 1)).cast("int"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.modality_status(kind("l_partkey"), kind("l_suppkey"), DEFAULT).alias("status"))


def _w(c: str, alternatives: str) -> str:
    return f"regexp_matches({c}, '\\b(?:{alternatives})\\b')"


_SPEC = lambda c: "CASE " + " ".join(f"WHEN {_w(c, words)} THEN '{name}'" for name, words in A.SPECIMENS) + " END"
_COMPL = A.COMPLICATED_SOURCE
_RULE_SQL = [
    ("care_or_surgery", "MISMATCH_INTERVENTION", f"CASE WHEN {_w('g', A.CARE)} AND {_w('t', A.SURGERY_TARGET)} AND NOT {_w('t', 'chăm sóc|cham soc')} THEN 'HIGH' WHEN {_w('g', A.SURGERY_SOURCE)} AND {_w('t', A.CARE_TARGET)} AND NOT {_w('t', 'mở thông|phẫu thuật|cắt')} THEN 'HIGH' END"),
    ("tube_or_ostomy", "MISMATCH_METHOD", "CASE WHEN contains(g, 'ống thông') AND contains(t, 'mở thông') AND NOT contains(g, 'mở thông') THEN 'HIGH' END"),
    ("specimen", "MISMATCH_SPECIMEN", f"CASE WHEN ({_SPEC('g')}) <> ({_SPEC('t')}) THEN 'HIGH' END"),
    ("scope_or_open", "MISMATCH_METHOD", f"CASE WHEN {_w('g', A.SCOPE)} AND {_w('t', 'mổ mở|mo mo|mở|phẫu thuật mở')} AND NOT {_w('t', A.SCOPE)} THEN 'HIGH' WHEN {_w('g', 'mổ mở|mo mo|phẫu thuật mở')} AND NOT {_w('g', A.SCOPE)} AND {_w('t', A.SCOPE)} THEN 'HIGH' END"),
    ("complication", "MISMATCH_SEVERITY", f"CASE WHEN {_w('g', _COMPL)} AND {_w('t', A.SIMPLE)} THEN 'MEDIUM' WHEN {_w('g', _COMPL)} AND NOT {_w('t', A.COMPLICATED)} AND t <> '' THEN 'LOW' END"),
    ("sides", "MISMATCH_ANATOMY", f"CASE WHEN {_w('g', A.ONE_SIDE)} AND {_w('t', A.BOTH_SIDES)} THEN 'HIGH' WHEN {_w('g', A.BOTH_SIDES)} AND {_w('t', A.ONE_SIDE)} THEN 'MEDIUM' END"),
    ("frequency", "MISMATCH_METHOD", f"CASE WHEN {_w('g', A.ONCE)} AND {_w('t', A.SERIES)} THEN 'HIGH' END"),
    ("guidance", "MISMATCH_METHOD", f"CASE WHEN {_w('g', A.GUIDED)} AND NOT {_w('t', A.GUIDED)} AND t <> '' THEN 'MEDIUM' WHEN NOT {_w('g', A.GUIDED)} AND {_w('t', A.GUIDED)} THEN 'HIGH' END"),
]


def _audit_sql(name: str, target: str, score: str) -> str:
    hits = ", ".join(f"CASE WHEN s{i} IS NOT NULL THEN {{'rule': '{r}', 'type': '{k}', 'severity': s{i}}} END" for i, (r, k, _) in enumerate(_RULE_SQL))
    return f"""{name}_s AS (SELECT row_id, score, skip, {", ".join(f"{c} AS s{i}" for i, (_, _, c) in enumerate(_RULE_SQL))} FROM (SELECT row_id, {score} AS score, lower(name) AS g, lower({target}) AS t, name = '' OR {target} = '' OR trim(lower(name)) = trim(lower({target})) AS skip FROM pairs)),
{name}_h AS (SELECT row_id, score, skip, CASE WHEN skip THEN [] ELSE list_filter([{hits}], lambda h: h IS NOT NULL) END AS h FROM {name}_s),
{name} AS (SELECT row_id, len(h) > 0 OR (NOT skip AND score > 0 AND score < {A.NO_RULE_SCORE}) AS warning, CASE WHEN len(h) > 0 THEN h[1].type WHEN NOT skip AND score > 0 AND score < {A.NO_RULE_SCORE} THEN 'LOW_CONFIDENCE' ELSE 'NONE' END AS type,
  CASE WHEN len(list_filter(h, lambda x: x.severity = 'HIGH')) > 0 THEN 'HIGH' WHEN len(list_filter(h, lambda x: x.severity = 'MEDIUM')) > 0 THEN 'MEDIUM' WHEN len(h) > 0 THEN 'LOW' WHEN NOT skip AND score > 0 AND score < {A.NO_RULE_SCORE} THEN 'LOW' ELSE 'SAFE' END AS severity,
  array_to_string(list_transform(h, lambda x: x.rule), '|') AS rules FROM {name}_h)"""


@query(f"WITH {_PAIRS_SQL}, {_audit_sql('a', 'name_1', 'score_1')} SELECT row_id, warning, type, severity, rules FROM a")
def audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.audit_pair(_pairs(spark, sf_dir), "name", "name_1", "score_1")
    return out.select("row_id", "audit.warning", "audit.type", "audit.severity", F.array_join("audit.details.rule", "|").alias("rules"))


@query(f"""WITH {_PAIRS_SQL}, {_audit_sql('a', 'name_1', 'score_1')}, {_audit_sql('b', 'name_2', 'score_2')}
SELECT row_id, a.warning OR b.warning AS warning, CASE WHEN a.warning THEN a.type WHEN b.warning THEN b.type ELSE 'NONE' END AS type,
CASE WHEN a.warning AND b.warning THEN CASE WHEN a.severity = 'HIGH' OR b.severity = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END WHEN a.warning THEN a.severity WHEN b.warning THEN b.severity ELSE 'SAFE' END AS severity,
CASE WHEN a.warning AND b.warning THEN 'BOTH' WHEN a.warning THEN 'PL1' WHEN b.warning THEN 'PL2' ELSE 'NONE' END AS flag FROM a JOIN b USING (row_id)""")
def audit_row_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = A.audit_pair(A.audit_pair(_pairs(spark, sf_dir), "name", "name_1", "score_1", "a"), "name", "name_2", "score_2", "b")
    return A.audit_row(both, "a", "b").select("row_id", "audit.warning", "audit.type", "audit.severity", "audit.flag")


@query()
def audit_rules_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.audit_pair(_pairs(spark, sf_dir), "name", "name_1", "score_1", boundary="unicode")
    return out.select("row_id", "audit.warning", "audit.type", "audit.severity", F.array_join("audit.details.rule", "|").alias("rules"))


@query()
def service_rules_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.service_audit(_pairs(spark, sf_dir).select("row_id", "name", "name_1", "name_2"), "name", "name_1", "name_2").select("row_id", "warning", "type", "severity", "rules", "flag")


def _first_hit_sql(i: int) -> tuple[str, str]:
    _, _, _, src, tgt, second = A.FIRST_HIT[i]
    return f"regexp_matches(g, '{src}') AND (regexp_matches(t2, '{tgt}')" + (f" OR regexp_matches(t1, '{tgt}')" if second else "") + ")", f"CASE WHEN regexp_matches(t2, '{second}') THEN 'PL2' ELSE 'PL1' END" if second else "'PL2'"


_FIRST = [(*_first_hit_sql(i), *r[:3]) for i, r in enumerate(A.FIRST_HIT)]


@query(f"""WITH {_PAIRS_SQL}, l AS (SELECT row_id, lower(name) AS g, lower(name_1) AS t1, lower(name_2) AS t2 FROM pairs)
SELECT row_id, {' OR '.join(f'({c})' for c, *_ in _FIRST)} AS warning, CASE {' '.join(f"WHEN {c} THEN '{k}'" for c, _, _, k, _ in _FIRST)} ELSE 'NONE' END AS type, CASE {' '.join(f"WHEN {c} THEN '{s}'" for c, _, _, _, s in _FIRST)} ELSE 'SAFE' END AS severity,
CASE {' '.join(f"WHEN {c} THEN '{n}'" for c, _, n, _, _ in _FIRST)} ELSE '' END AS rules, CASE {' '.join(f"WHEN {c} THEN {f}" for c, f, *_ in _FIRST)} ELSE 'NONE' END AS flag FROM l""")
def service_rules_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.service_audit_first(_pairs(spark, sf_dir).select("row_id", "name", "name_1", "name_2"), "name", "name_1", "name_2").select("row_id", "warning", "type", "severity", "rules", "flag")


#: Queries as people type them (id, query).
TYPED = [(1, "ring"), (2, "RED bolt"), (3, "bolt red"), (4, "brand#1"), (5, "Brand#12"), (6, "bo"), (7, "economy hot gear"), (8, "eco"), (9, "ring, small"), (10, "no such thing"), (11, "small ri"), (12, "in ring"), (13, "***"), (14, "widget economy xyz")]
_TIER_SQL = "CASE WHEN low = q_low OR clean = q_clean THEN {'s': 100.0, 'm': 'EXACT'} WHEN starts_with(clean, q_clean) THEN {'s': 95 + 4 * r, 'm': 'PREFIX'} WHEN contains(clean, q_clean) THEN {'s': 90 + 5 * r, 'm': 'SUBSTRING'} WHEN n >= 2 AND hit = n THEN {'s': 84 + CASE WHEN falls = 0 THEN 4 ELSE 0 END + 4 * r, 'm': 'ALL_WORDS'} WHEN n >= 2 AND hit < n AND hit * 2 >= n THEN {'s': 35.0 * hit / n, 'm': 'FUZZY'} WHEN n = 1 AND hit = 1 THEN {'s': 80 + 8 * r, 'm': 'SUBSTRING'} END"


@query(f"""WITH typed AS (SELECT id::BIGINT AS query_id, query FROM {_values(TYPED)} v(id, query) UNION ALL SELECT 100 + min(p_partkey), p_name FROM part GROUP BY p_name),
q AS (SELECT query_id, lower(trim(query)) AS q_low, {LITE_SQL.format("query")} AS q_clean, string_split(lower(trim(query)), ' ')[1] AS first FROM typed),
qs AS (SELECT *, list_filter(string_split(q_clean, ' '), lambda t: t <> '') AS q_toks FROM q),
i AS (SELECT id AS idx, name, lower(p_brand) AS low_code, lower(trim(name)) AS low, {LITE_SQL.format("name")} AS clean FROM (SELECT p_partkey AS id, p_type || ' ' || p_name AS name, p_brand FROM part)),
p AS (SELECT *, len(q_toks) AS n, least(length(q_clean) / greatest(length(clean), 1), 1.0) AS r, list_transform(q_toks, lambda t: coalesce(list_position(list_transform(list_filter(string_split(clean, ' '), lambda x: x <> ''), lambda x: starts_with(x, t)), true), 0) - 1) AS places,
  CASE WHEN low_code = q_low THEN 100.0 WHEN low_code <> '' AND starts_with(low_code, q_low) THEN 98.0 WHEN low_code <> '' AND contains(low_code, q_low) THEN 92.0 ELSE 0.0 END AS s0 FROM i JOIN qs ON NOT (length(first) >= 3 AND len(q_toks) >= 2) OR contains(low, first) OR contains(low_code, q_low)),
h AS (SELECT *, len(list_filter(places, lambda x: x >= 0)) AS hit, len(list_filter(range(2, len(places) + 1), lambda k: places[k] < places[k - 1])) AS falls FROM p),
t AS (SELECT *, CASE WHEN s0 < 99 THEN {_TIER_SQL} END AS tier FROM h),
scored AS (SELECT query_id, idx, name, greatest(s0, coalesce(tier.s, 0)) AS s, coalesce(tier.m, CASE WHEN s0 > 0 THEN 'CODE' ELSE 'FUZZY' END) AS m FROM t)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 10 + 0.5) / 10 DESC, length(name), idx)::INT AS rank, idx, (floor(s * 10 + 0.5) / 10)::DOUBLE AS score, m AS match_type FROM scored WHERE s >= 25 OR m = 'CODE' QUALIFY rank <= 15""")
def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed queries and all names of parts searched in types and names, brands as codes: the tiers without fuzzy matches."""
    part = _table(spark, sf_dir, "part")
    named = part.groupBy("p_name").agg((F.min("p_partkey") + 100).alias("query_id")).select("query_id", F.col("p_name").alias("query"))
    typed = spark.createDataFrame(TYPED, "query_id long, query string").unionByName(named)
    return search(typed, _searched(part), fuzzy=False).select("query_id", "rank", "idx", "score", "match_type")


def _searched(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("code"), F.concat_ws(" ", "p_type", "p_name").alias("name"))


@query()
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt one-word queries, held against every name."""
    q = spark.createDataFrame([(1, "economy smal ring"), (2, "econommy"), (3, "rign"), (4, "")], "query_id long, query string")
    return search(q, _searched(_table(spark, sf_dir, "part"))).select("query_id", "rank", "idx", "score", "match_type")


@query(f"""WITH n AS (SELECT p_type || ' ' || p_name AS name, min(p_partkey) AS idx FROM part GROUP BY 1),
pairs AS (SELECT a.idx AS a, b.idx AS b, length(a.name) + length(b.name) AS size, list_sum(list_transform(list_distinct(string_split(a.name, '')), lambda c: least(length(a.name) - length(replace(a.name, c, '')), length(b.name) - length(replace(b.name, c, '')))))::BIGINT AS common, levenshtein(a.name, b.name) AS far
  FROM n a JOIN n b ON a.idx < b.idx)
SELECT a, b, common FROM pairs WHERE common * 2 >= {SIMILAR} * size AND far <= (1 - {SIMILAR}) * size + 1e-9""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names that can have a sequence ratio of SIMILAR, by the characters that they have in common."""
    n = _names(spark, sf_dir).groupBy("name").agg(F.min("id").alias("idx"))
    found = overlapping(n.select(F.col("idx").alias("q"), F.col("name").alias("wanted")), n.select("idx", F.col("name").alias("text")), SIMILAR).filter("q < idx")
    near = found.join(n.select(F.col("idx").alias("q"), F.col("name").alias("x")), "q").join(n.withColumnRenamed("name", "y"), "idx").filter(distance_allows(F.col("x"), F.col("y"), SIMILAR))
    return near.select(F.col("q").alias("a"), F.col("idx").alias("b"), F.col("common").cast("long").alias("common"))


@query("""WITH q AS (SELECT DISTINCT p_brand AS query FROM part), i AS (SELECT p_partkey AS idx, lower(p_brand) AS code FROM part)
SELECT query, idx, row_number() OVER (PARTITION BY query ORDER BY idx)::BIGINT AS rank FROM q JOIN i ON code = lower(query) QUALIFY rank <= 15""")
def search_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands searched as codes: equal ones come first, in order."""
    part = _table(spark, sf_dir, "part")
    q = part.select("p_brand").distinct().select(F.xxhash64("p_brand").alias("query_id"), F.col("p_brand").alias("query"))
    found = search(q, part.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("code"), F.lit("item").alias("name")), fuzzy=False)
    return found.filter("score = 100").join(q, "query_id").select("query", "idx", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN (count(*) FILTER (event_type <> 'error') OVER (ORDER BY event_id))::VARCHAR ELSE '' END AS ordinal FROM events")
def running_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ordinals(_table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") != "error", "event_id").select("event_id", "ordinal")


_MAJOR, _MINOR = "user_id % 17 = 0", "user_id % 5 = 0"


@query(f"""WITH e AS (SELECT event_id, CASE WHEN {_MAJOR} THEN 'M' || user_id END AS major, CASE WHEN NOT ({_MAJOR}) AND {_MINOR} THEN 'N' || user_id END AS minor FROM events),
g AS (SELECT *, count(major) OVER (ORDER BY event_id) AS grp FROM e),
f AS (SELECT event_id, last_value(major IGNORE NULLS) OVER (ORDER BY event_id) AS m, last_value(minor IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id) AS n FROM g)
SELECT event_id, concat_ws(' > ', m, n) AS chapter FROM f""")
def chapter_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return C.fill_chapters(e, F.when(F.expr(_MAJOR), F.concat(F.lit("M"), "user_id")), F.when(F.expr(_MINOR), F.concat(F.lit("N"), "user_id")), "event_id").select("event_id", "chapter")


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as result rows: matches by priority, warnings by status."""
    o = _table(spark, sf_dir, "orders")
    one = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("")
    two = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise("")
    return o.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), F.lit("").alias("name"), one.alias("name_1"), two.alias("name_2"), one.alias("code_1"), two.alias("code_2"), (F.col("o_orderstatus") == "F").alias("warning"), (F.col("o_orderkey") % 10 == 0).alias("is_locked"))


_MAPPING_SQL = "m AS (SELECT o_orderkey AS row_id, 'C' || o_custkey AS code, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS name_1, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END AS name_2, o_orderstatus = 'F' AS warning, o_orderkey % 10 = 0 AS is_locked FROM orders)"


@query(f"WITH {_MAPPING_SQL} SELECT count(*) AS total, count(*) FILTER (name_1 <> '') AS matched_1, count(*) FILTER (name_2 <> '') AS matched_2, count(*) FILTER (name_1 <> '' AND name_2 <> '') AS matched_both, count(*) FILTER (name_1 = '' AND name_2 = '') AS unmatched FROM m")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_stats(_mapping(spark, sf_dir))


@query(f"WITH {_MAPPING_SQL} SELECT 'both' AS status, row_id FROM m WHERE name_1 <> '' AND name_2 <> '' UNION ALL SELECT 'pl1_only', row_id FROM m WHERE name_1 <> '' AND name_2 = '' UNION ALL SELECT 'pl2_only', row_id FROM m WHERE name_1 = '' AND name_2 <> '' UNION ALL SELECT 'unmatched', row_id FROM m WHERE name_1 = '' AND name_2 = '' UNION ALL SELECT 'warning_only', row_id FROM m WHERE warning UNION ALL SELECT 'locked_only', row_id FROM m WHERE is_locked")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapping(spark, sf_dir)
    each = [R.by_status(m, s).select(F.lit(s).alias("status"), "row_id") for s in ("both", "pl1_only", "pl2_only", "unmatched", "warning_only", "locked_only")]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


@query(f"WITH {_MAPPING_SQL} SELECT row_id FROM m WHERE contains(lower(code), 'c1') OR contains(lower(name_1), 'c1') OR contains(row_id::VARCHAR, 'c1')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_keyword(_mapping(spark, sf_dir), " C1 ", ["code", "name_1", "row_id"]).select("row_id")


@query(f"WITH {_MAPPING_SQL} SELECT row_id, code FROM m ORDER BY row_id LIMIT 50 OFFSET 100")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(_mapping(spark, sf_dir).select("row_id", "code"), 3, 50)


@query(f"SELECT facet, count(*) AS n FROM (SELECT DISTINCT id, unnest([trim(coalesce(s, '')), trim(string_split(coalesce(s, ''), '>')[-1])]) AS facet FROM (SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN p_brand || ' > ' || p_type WHEN p_size % 2 = 0 THEN p_type END AS s FROM part UNION ALL SELECT -id, s FROM {_values(SPECIALTIES)} v(id, s))) WHERE facet <> '' GROUP BY facet")
def facet_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types of parts as two levels of a specialty, some with one level or none; and the inline ones."""
    said = F.when(F.col("p_size") % 7 > 0, F.concat_ws(" > ", "p_brand", "p_type")).when(F.col("p_size") % 2 == 0, F.col("p_type"))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("specialty"))
    return R.facet_specialties(parts.unionByName(spark.createDataFrame([(-i, x) for i, x in SPECIALTIES], "id long, specialty string")))


#: A dimension whose keys stand for several members.
GROUPS = [("western", ["en", "fr", "de"]), ("southern", ["es", "fr"]), ("early", ["src0", "src1", "src2"]), ("none", ["xx"])]


@query(f"WITH g AS (SELECT key, unnest(string_split(members, ',')) AS member FROM {_values([(k, ','.join(m)) for k, m in GROUPS])} v(key, members)) SELECT key, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest([lang, source]) AS member FROM documents) d JOIN g USING (member) GROUP BY key")
def facet_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("member"))
    return R.facet_members(d, spark.createDataFrame(GROUPS, "key string, members array<string>"), "key", "members")


_LABEL_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[-/,]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH e AS (SELECT DISTINCT string_split(text, ' ')[1] || ' - ' || string_split(text, ' ')[2] AS entry FROM benchmark WHERE len(string_split(text, ' ')) > 1),
n AS (SELECT entry, {_LABEL_SQL.format("entry")} AS w FROM e), t AS (SELECT entry, w, list_filter(string_split(w, ' '), lambda x: length(x) >= 3) AS ws FROM n),
d AS (SELECT {_LABEL_SQL.format("CASE WHEN doc_id % 10 > 0 THEN lang || ' > ' || source END")} AS s, {_LABEL_SQL.format("text")} AS a FROM documents WHERE doc_id % 10 > 0 OR coalesce(text, '') <> '')
SELECT entry, count(*) AS n FROM t JOIN d ON contains(s, w) OR contains(w, s) OR contains(a, w) OR (len(ws) > 0 AND len(list_filter(ws, lambda x: contains(s, x) OR contains(a, x))) >= least(2, len(ws))) GROUP BY entry""")
def facet_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the entries that they belong to: a tenth has no specialty; the whole text stands for the anatomy, beginnings of the benchmark's items for the entries."""
    words = F.split("text", " ")
    entries = _table(spark, sf_dir, "benchmark").filter(F.size(words) > 1).select(F.concat(words[0], F.lit(" - "), words[1]).alias("entry"))
    rows = _table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 > 0, F.concat("lang", F.lit(" > "), "source")).alias("specialty"), F.col("text").alias("anatomy"))
    return R.facet_ontology(rows, entries)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS warnings, count(*) FILTER (o_orderkey % 10 = 0) AS locked FROM orders")
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.warning_counts(_mapping(spark, sf_dir))


@query(f"""WITH {_MAPPING_SQL}, held AS (SELECT code, name_1, row_number() OVER (PARTITION BY code ORDER BY row_id DESC) AS n FROM m WHERE is_locked)
SELECT row_id, m.code, CASE WHEN held.code IS NOT NULL THEN held.name_1 ELSE m.name_1 END AS name_1, held.code IS NOT NULL AS is_locked FROM m LEFT JOIN held ON held.code = m.code AND n = 1""")
def lock_preserving_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapping(spark, sf_dir)
    return M.with_locks(m.select("row_id", "code", "name", "name_1"), m.select("row_id", "code", "name", "name_1", "is_locked")).select("row_id", "code", "name_1", "is_locked")


@query("""WITH e AS (SELECT l_orderkey AS row_id, l_shipdate, l_linenumber AS seq, l_returnflag AS s FROM lineitem), last AS (SELECT row_id, s FROM e QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY seq DESC) = 1)
SELECT o_orderkey AS row_id, coalesce(last.s, o_orderstatus) AS status, o_orderpriority AS priority FROM orders LEFT JOIN last ON last.row_id = o_orderkey""")
def edit_log_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    # an order may have several lines of one number: the first in the table counts, as it does in the SQL read by one thread
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    edits = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("edit_seq"), F.col("l_returnflag").alias("status"), *place)
    return R.resolve_edits(rows, edits, ["status"], ties=("file", "at"))


@query("SELECT c_custkey, trim(string_split(c_name, '#')[2]) AS extra_1, '' AS extra_2 FROM customer")
def extra_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.split("c_name", "#").alias("cells"))
    return R.passthrough(rows, [("extra_1", "cells", 1), ("extra_2", "cells", 9)]).drop("cells")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 0 THEN 'Locked (' || o_orderpriority || ')' WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'Serious conflict' ELSE 'To be checked' END WHEN o_orderkey % 3 <> 0 THEN 'Matched' ELSE 'Unmatched' END || CASE WHEN o_orderstatus = 'F' THEN ' (price -> look)' ELSE '' END AS status FROM orders")
def export_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), R.export_status(F.col("o_orderkey") % 10 == 0, F.col("o_orderpriority"), F.col("o_orderstatus") == "F", F.when(F.col("o_totalprice") > 100000, "HIGH").otherwise("LOW"), F.lit("price"), F.lit("look"), F.col("o_orderkey") % 3 != 0).alias("status"))


@query("SELECT o_custkey AS session_id, max(o_orderdate) AS saved_at, count(*) AS n_results, count(*) FILTER (o_orderkey % 10 = 0) AS n_locked FROM orders GROUP BY o_custkey")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return R.list_sessions(o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("saved_at"), (F.col("o_orderkey") % 10 == 0).alias("is_locked")))


@query("SELECT s_suppkey, 'Name: ' || s_name || CASE WHEN s_acctbal > 0 THEN chr(10) || 'State: solvent' ELSE '' END AS report FROM supplier")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", R.report_text(s, [("Name", F.col("s_name")), ("State", F.when(F.col("s_acctbal") > 0, "solvent")), ("Note", F.lit(""))]).alias("report"))


_N = len(PAIRS)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as linked rows, their names those of the procedures of their first lines, audited."""
    p = _pairs(spark, sf_dir).filter("row_id >= 0").withColumn("is_locked", F.col("row_id") % 10 == 0)
    none = lambda kind: F.lit(None).cast(kind)
    code = lambda n: F.when(F.col(f"name_{n}") != "", F.concat(F.lit(f"C{n}-"), (F.col("row_id") % _N).cast("string"))).otherwise("").alias(f"code_{n}")
    rows = p.select("row_id", F.concat(F.lit("S"), F.col("row_id").cast("string")).alias("code"), "name", code(1), "name_1", "score_1", none("string").alias("anatomy_1"), code(2), "name_2", "score_2", none("string").alias("anatomy_2"), "is_locked", F.lit(False).alias("is_manual_override"), none("string").alias("manual_note"), none("timestamp").alias("locked_at"))
    return V.audit_rows(rows)


_LINKED_SQL = f"""{_PAIRS_SQL},
l AS (SELECT row_id AS id, row_id AS p, row_id % 10 = 0 AS is_locked, name, CASE WHEN name_1 <> '' THEN 'C1-' || row_id % {_N} ELSE '' END AS code_1, name_1, score_1, CASE WHEN name_2 <> '' THEN 'C2-' || row_id % {_N} ELSE '' END AS code_2, name_2, score_2 FROM pairs WHERE row_id >= 0),
none AS (SELECT row_id, FALSE AS warning, 'NONE' AS type, 'SAFE' AS severity, '' AS rules FROM pairs)"""
_BOTH_SQL = "CASE WHEN x.warning AND y.warning THEN CASE WHEN x.severity = 'HIGH' OR y.severity = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END WHEN x.warning THEN x.severity WHEN y.warning THEN y.severity ELSE 'SAFE' END AS severity, CASE WHEN x.warning AND y.warning THEN 'BOTH' WHEN x.warning THEN 'PL1' WHEN y.warning THEN 'PL2' ELSE 'NONE' END AS flag"
_SHOWN = ["row_id", "code_1", "name_1", "score_1", "code_2", "name_2", "score_2", "is_locked", "is_manual_override", "manual_note"]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*_SHOWN, F.col("audit.severity").alias("severity"), F.col("audit.flag").alias("flag"))


@query(f"""WITH {_LINKED_SQL}, {_audit_sql('a', 'name_1', 'score_1')}, {_audit_sql('b', 'name_2', 'score_2')}, {_audit_sql('c', 'name_2', '88.0')},
r AS (SELECT *, id % 5 = 0 AS pick, id % 7 = 0 AS clear FROM l),
x AS (SELECT 'a' AS k, * FROM a UNION ALL SELECT 'c', * FROM c), y AS (SELECT 'b' AS k, * FROM b UNION ALL SELECT 'n', row_id, warning, type, severity, rules FROM none)
SELECT id AS row_id, CASE WHEN pick THEN 'N' || id ELSE code_1 END AS code_1, CASE WHEN pick THEN name_2 ELSE name_1 END AS name_1, CASE WHEN pick THEN 88.0 ELSE score_1 END::DOUBLE AS score_1, CASE WHEN clear THEN '' ELSE code_2 END AS code_2, CASE WHEN clear THEN '' ELSE name_2 END AS name_2, CASE WHEN clear THEN 0.0 ELSE score_2 END::DOUBLE AS score_2,
  is_locked OR pick OR clear AS is_locked, pick OR clear AS is_manual_override, CASE WHEN clear THEN 'Match taken away by hand [PL2]' WHEN pick THEN 'Match picked by hand [PL1]' END AS manual_note, {_BOTH_SQL}
FROM r JOIN x ON x.row_id = p AND x.k = CASE WHEN pick THEN 'c' ELSE 'a' END JOIN y ON y.row_id = p AND y.k = CASE WHEN clear THEN 'n' ELSE 'b' END""")
def review_inline_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row gets its second match as its first, after another pick; every seventh loses its second."""
    rows = _linked(spark, sf_dir)
    blank = lambda seq, side: (F.lit(seq).alias("seq"), F.lit(side).alias("side"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("anatomy"))
    fifth, seventh = rows.filter("row_id % 5 = 0"), rows.filter("row_id % 7 = 0")
    picked = fifth.select("row_id", F.lit(2).alias("seq"), F.lit("PL1").alias("side"), F.concat(F.lit("N"), F.col("row_id").cast("string")).alias("code"), F.col("name_2").alias("name"), F.lit(88.0).alias("score"), F.lit("x").alias("anatomy"))
    return _shown(V.pick_inline(rows, picked.unionByName(fifth.select("row_id", *blank(1, "PL1"))).unionByName(seventh.select("row_id", *blank(3, "PL2")))))


@query(f"""WITH {_LINKED_SQL}, {_audit_sql('a', 'name_1', 'score_1')}, {_audit_sql('b', 'name_2', 'score_2')},
r AS (SELECT *, id % 3 = 0 AS one, id % 4 = 0 AS two FROM l),
x AS (SELECT 'a' AS k, * FROM a UNION ALL SELECT 'n', row_id, warning, type, severity, rules FROM none), y AS (SELECT 'b' AS k, * FROM b UNION ALL SELECT 'n', row_id, warning, type, severity, rules FROM none)
SELECT id AS row_id, CASE WHEN one THEN '' ELSE code_1 END AS code_1, CASE WHEN one THEN '' ELSE name_1 END AS name_1, CASE WHEN one THEN 0.0 ELSE score_1 END::DOUBLE AS score_1, CASE WHEN two THEN '' ELSE code_2 END AS code_2, CASE WHEN two THEN '' ELSE name_2 END AS name_2, CASE WHEN two THEN 0.0 ELSE score_2 END::DOUBLE AS score_2,
  is_locked, FALSE AS is_manual_override, NULL::VARCHAR AS manual_note, {_BOTH_SQL}
FROM r JOIN x ON x.row_id = p AND x.k = CASE WHEN one THEN 'n' ELSE 'a' END JOIN y ON y.row_id = p AND y.k = CASE WHEN two THEN 'n' ELSE 'b' END""")
def review_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches taken away, and the rows audited anew."""
    rows = _linked(spark, sf_dir)
    side = F.when((F.col("row_id") % 3 == 0) & (F.col("row_id") % 4 == 0), "BOTH").when(F.col("row_id") % 3 == 0, "PL1").when(F.col("row_id") % 4 == 0, "PL2")
    return _shown(V.clear_and_audit(rows, rows.select("row_id", side.alias("side")).filter("side IS NOT NULL")))


@query(f"""WITH {_LINKED_SQL}, {_audit_sql('a', 'name_1', 'score_1')}, {_audit_sql('b', 'name_2', 'score_2')}, {_audit_sql('c', 'name_2', '100.0')},
r AS (SELECT *, id % 4 = 1 AS edit FROM l), x AS (SELECT 'a' AS k, * FROM a UNION ALL SELECT 'c', * FROM c), y AS (SELECT * FROM b)
SELECT id AS row_id, CASE WHEN edit THEN code_2 ELSE code_1 END AS code_1, CASE WHEN edit THEN name_2 ELSE name_1 END AS name_1, CASE WHEN NOT edit OR (code_1 = code_2 AND name_1 = name_2) THEN score_1 WHEN code_2 = '' AND name_2 = '' THEN 0.0 ELSE 100.0 END::DOUBLE AS score_1, code_2, name_2, score_2,
  CASE WHEN edit THEN id % 8 = 1 ELSE is_locked END AS is_locked, edit AND (id % 8 = 1 OR is_locked OR code_1 <> code_2 OR name_1 <> name_2 OR id % 3 <> 0) AS is_manual_override, CASE WHEN edit AND id % 3 = 1 THEN 'seen' END AS manual_note, {_BOTH_SQL}, edit AND id % 8 = 1 AS timed
FROM r JOIN x ON x.row_id = p AND x.k = CASE WHEN edit THEN 'c' ELSE 'a' END JOIN y ON y.row_id = p""")
def review_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row gets its second match as its first, some of them a lock and a note."""
    rows = _linked(spark, sf_dir)
    k = F.col("row_id")
    edits = rows.filter("row_id % 4 = 1").select("row_id", F.col("code_2").alias("code_1"), F.col("name_2").alias("name_1"), "code_2", "name_2", (k % 8 == 1).alias("is_locked"), F.when(k % 3 == 1, " seen ").when(k % 3 == 2, "  ").alias("manual_note"))
    done = V.save_override(rows, edits)
    return done.select(*_SHOWN, F.col("audit.severity").alias("severity"), F.col("audit.flag").alias("flag"), F.col("locked_at").isNotNull().alias("timed"))


@query(f"""WITH {_LINKED_SQL}, {_audit_sql('a', 'name_1', 'score_1')}, {_audit_sql('b', 'name_2', 'score_2')}
SELECT count(*) FILTER (name_1 <> '' OR name_2 <> '') AS audited, count(*) FILTER (a.warning OR b.warning) AS warnings, count(*) FILTER (name_1 <> '' OR name_2 <> '') - count(*) FILTER (a.warning OR b.warning) AS safe FROM l JOIN a ON a.row_id = p JOIN b ON b.row_id = p""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.audit_summary(_linked(spark, sf_dir))


@query(f"WITH {_MAPPING_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (name_1 <> '') AS matched_1, count(*) FILTER (name_2 <> '') AS matched_2, count(*) FILTER (name_1 <> '' AND name_2 <> '') AS matched_both, count(*) FILTER (name_1 = '' AND name_2 = '') AS unmatched FROM m) SELECT *, {', '.join(f'round_even({c} * 100 / total, 1)::DOUBLE AS {c}_pct' for c in ('matched_1', 'matched_2', 'matched_both', 'unmatched'))} FROM s")
def run_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_shares(M.run_stats(_mapping(spark, sf_dir)))


_NAMED = "map {" + ", ".join(f"'{c}': '{shown}'" for c, (shown, _) in DEFAULT.ontology.items()) + "}"


@query(f"""WITH {_PAIRS_SQL}, n AS (SELECT name, list_filter(c, lambda x, i: list_position(c, x) = i) AS terms, cat FROM (SELECT name, {_ANAT_SQL.removeprefix("list_distinct(").removesuffix(")")} AS c, {_CAT_SQL} AS cat FROM (SELECT DISTINCT name, lower(name) AS clean FROM pairs WHERE row_id >= 0))),
o AS (SELECT o_orderkey AS row_id, name, CASE WHEN o_orderstatus = 'F' THEN 'Chapter ' || o_orderpriority WHEN o_orderstatus = 'O' THEN '' END AS chapter FROM orders JOIN pairs ON pairs.row_id = o_orderkey)
SELECT row_id, coalesce(nullif(trim(chapter), ''), {_NAMED}[cat], 'Unclassified') AS specialty_label, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ', ') END AS anatomy_label FROM o JOIN n USING (name)""")
def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the labels of specialty and anatomy of their first procedure."""
    chapter = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Chapter "), "o_orderpriority")).when(F.col("o_orderstatus") == "O", "")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), chapter.alias("chapter")).join(_pairs(spark, sf_dir).select("row_id", "name"), "row_id")
    names = D.decompose(o.select("name").distinct().withColumn("clean", F.lower("name")), "clean", DEFAULT).select("name", "anatomy", "category")
    return V.labels(o.join(names, "name"), DEFAULT).select("row_id", "specialty_label", "anatomy_label")


@query("SELECT o_orderkey AS row_id, trim(o_orderpriority) AS extra_1, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 0 THEN o_orderstatus ELSE '' END AS extra_2, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 0 THEN 'b' ELSE '' END AS extra_3, '' AS extra_4 FROM orders")
def extras_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("row_id"), F.array(F.concat(F.lit(" "), "o_orderpriority")).alias("cells"), F.array("o_orderstatus").alias("cells_1"), F.array(F.lit("a"), F.lit(" b ")).alias("cells_2"), F.when(k % 3 != 0, "n").otherwise("").alias("name_1"), F.when(k % 4 != 0, "n").alias("name_2"), (k % 10 == 0).alias("is_locked"))
    return V.extras(rows, [("extra_1", "source", 0), ("extra_2", "PL1", 0), ("extra_3", "PL2", 1), ("extra_4", "source", 7)]).select("row_id", "extra_1", "extra_2", "extra_3", "extra_4")


@query()
def audit_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders audited with the vocabulary: kinds of procedure and organs that exclude each other come first."""
    rows = V.audit_rows(_linked(spark, sf_dir).drop("audit").filter("row_id >= 0"), DEFAULT)
    return rows.select("row_id", "audit.warning", "audit.type", "audit.severity", "audit.flag", F.array_join("audit.details.rule", "|").alias("rules"))


@query()
def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.audit_report(_linked(spark, sf_dir))


@query()
def close_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts linked by sequence ratio alone."""
    src, tgt = _halves(spark, sf_dir)
    return M.close_match(src, tgt, 0.6).select("q", "match_code", "match_score")
