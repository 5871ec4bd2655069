import pytest

from conftest import column
from scorekit.operators import encoding
from scorekit.sources import dictionaries


@pytest.mark.parametrize(
    ("name", "value", "code"),
    [
        ("gender", "男性", 1),
        ("gender", "女性", 2),
        ("occupation", "运输设备和通用工程机械操作人员及有关人员", 8),
        ("position", "（副）处级", 3),
        ("marriage", "丧偶", 5),
        ("residence", "未知", 8),
        ("residence", "其他", 4),
        ("education", "小学及以下", 9),
        ("education", "职高", 10),
        ("customer_level", "财富客户（中高端)", 5),
        ("customer_level", "财富客户（中高端）", 5),
        ("customer_level", "大众客户", 7),
        ("product", "信托", 6),
        ("asset_type", "定期存款", 2),
    ],
)
def test_built_in_codes(spark, name, value, code):
    df = spark.createDataFrame([(0, value), (1, value + " "), (2, None)], "i int, c string")
    assert column(encoding.encode_codes(df, "c", name), "c", "i") == [code, 0, 0]


def test_number_of_codes():
    sizes = {n: len(set(m.values())) for n, m in encoding.CODE_MAPS.items()}
    assert list(sizes.values()) == [2, 8, 6, 5, 8, 10, 7, 6, 7]


def test_dictionary_files(spark, tmp_path):
    headed = tmp_path / "headed.csv"
    headed.write_text("English,Chinese\nage,年龄\nsex,性别\nage,岁数\n", encoding="utf-8")
    words = dictionaries.read_headed_dictionary(spark, str(headed))
    names = encoding.name_list(spark, ["sex", "q", "age"], "feature_name")
    done = encoding.translate_or_slash(names, words)
    assert column(done, "中文名称", "position") == ["性别", "/", "岁数"]

    plain = tmp_path / "plain.csv"
    plain.write_text("age,年龄\nage,岁数\nsex,性别\n", encoding="utf-8")
    words = dictionaries.read_plain_dictionary(spark, str(plain))
    done = encoding.translate_or_keep(encoding.name_list(spark, ["q", "age"]), words)
    assert done.columns == ["position", "Eng_name", "Cha_name"]
    assert column(done, "Cha_name", "position") == ["q", "岁数"]


def test_dictionary_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("id,Chinese,English\n1,甲,a\n2,乙,b\n", encoding="utf-8")
    assert {r["English"]: r["Chinese"] for r in dictionaries.read_headed_dictionary(spark, str(path)).collect()} == {"a": "甲", "b": "乙"}
    with pytest.raises(ValueError, match="no column"):
        dictionaries.read_headed_dictionary(spark, str(path), key="Word")
