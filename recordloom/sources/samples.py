"""Small catalogs of our own to try things on, as tables and as workbooks with preamble and chapter rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.sources.xlsx import write_rows

#: (ordinal, code, name); rows without code open chapters.
SOURCE = [
    ("", "", "I. Nội khoa"), ("1", "01.0001", "Siêu âm tim *"), ("2", "01.0002", "ECG thường quy"), ("", "", "TIM MẠCH"), ("3", "01.0003", "Đo đường huyết mao mạch tại giường"),
    ("", "", "II. Ngoại khoa"), ("4", "02.0001", "PT nội soi cắt ruột thừa"), ("5", "02.0002", "Khâu phục hồi rách âm hộ"), ("6", "02.0003", "Chăm sóc ống thông bàng quang"),
]
FIRST = [("1", "A.001", "Siêu âm tim"), ("2", "A.002", "Điện tâm đồ thường quy"), ("3", "A.003", "Phẫu thuật nội soi cắt ruột thừa"), ("4", "A.004", "Khâu phục hồi rách bờ mi")]
SECOND = [("1", "B.001", "Siêu âm Doppler tim"), ("2", "B.002", "Mở thông bàng quang"), ("3", "B.003", "Đo đường huyết mao mạch")]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, n) for i, (_, c, n) in enumerate(SOURCE) if c], "q long, code string, name string")


def targets(spark: SparkSession, second: bool = False) -> DataFrame:
    return spark.createDataFrame([(i, c, n) for i, (_, c, n) in enumerate(SECOND if second else FIRST)], "idx long, code string, name string")


def write_workbooks(folder: str) -> dict[str, str]:
    """Three workbooks as sites send them; their paths by name."""
    head = {"source": ["TT", "Mã TT 43", "Danh mục kỹ thuật"], "first": ["Stt", "Mã kỹ thuật", "Tên kỹ thuật"], "second": ["Số TT", "Mã tương đương", "Tên kỹ thuật"]}
    made = {}
    for name, rows in (("source", SOURCE), ("first", FIRST), ("second", SECOND)):
        made[name] = f"{folder}/{name}.xlsx"
        write_rows(made[name], [[f"Catalog: {name}"], head[name], *map(list, rows)])
    return made
