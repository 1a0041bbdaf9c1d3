"""Prompt surface in six axes: counts and evidence of patterns, Japanese and English. Vocabulary, not meaning.

The words and patterns are the vocabulary that results must agree with: they are data, and the same as elsewhere by necessity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = tuple(f"H{i}" for i in range(2, 8))
_DO_JA = "確認 取得 削除 表示 送信 実行 変更 保存 開く 検索 生成 提出 作成 入力 閲覧".split()
_DO_EN = "check get delete display send execute change save open search generate submit create enter view".split()
_OF_JA = "情報 資料 データ ファイル 内容 結果 設定 文書 回答 コード 認証情報".split()
_OF_EN = "information document data file URL content result settings answer code credentials".split()


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_EN_ASKS = {"please": "please", "could_you": "could you", "would_you": "would you", "can_you": "can you", "i_would_like_you_to": "i would like you to"}
REQUESTS = {
    "kudasai": "してください", "kudasai_variant": "して下さい", "itadakemasu": "していただけますか", "kudasaimasenka": "してくださいませんか",
    "shite": r"(?<![\x{3040}-\x{309f}])して(?=\z|[。！？])", "onegaishimasu": "お願いします", "onegaidekimasuka": "お願いできますか",
} | {f"en_{k}": r"(?iU)\b" + v.replace(" ", r"\s+") + r"\b" for k, v in _EN_ASKS.items()}
PAIR_JA = f"(?:{_any([*_OF_JA, 'URL'])})[をは](?:{_any(_DO_JA)})"
PAIR_EN = rf"(?i)(?<![A-Za-z])(?:{_any(_DO_EN)})\s+(?:(?:the|an?|th(?:is|at)|my|your)\s+)?(?:{_any(_OF_EN)})(?![A-Za-z])"
_UNDO, _RULE = "ignore|disregard|override|forget|prioritize", r"(?:system\s+)?instructions?|rules?"
INTERFERENCE = (
    "(?id)(?:(?:以前の|上の|これまでの|システム)指示|優先順位|役割)[をは].{0,12}?(?:忘れ|最優先|無視|上書き|変更)"
    rf"|(?:{_UNDO}).{{0,24}}(?:{_RULE})|(?:(?:system|previous|above)\s+)?instructions?.{{0,12}}(?:{_UNDO})"
)
CONTROLS = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]"
_B64 = "+/0-9A-Za-z"
BASE64 = rf"(?<![{_B64}])[{_B64}]{{24,}}={{0,2}}(?![{_B64}])"
URL = r"(?iU)https?://\S+"
FILES = r"(?id)(?:開いて|読み込んで|参照|添付).{0,12}(?:CSV|PDF|文書|ファイル)|(?:open|load|referenced?|attached).{0,12}(?:CSV|PDF|document|file)"
_L = "a-zA-Z"
ACTIONS, TARGETS = _any(_DO_JA + _DO_EN), _any(_OF_JA + _OF_EN)
ACTION = rf"(?i)(?<![{_L}])(?:{ACTIONS})(?![{_L}])"
TARGET = rf"(?i)(?<![{_L}])(?:{TARGETS})(?![{_L}])"


def _patterns(rules: dict[str, str]) -> list[tuple[str, str, str]]:
    """axis, code, pattern, in the order of evidence."""
    return [
        *(("H2", f"request:{k}", p) for k, p in REQUESTS.items()),
        ("H3", "action_target", PAIR_JA), ("H3", "action_target", PAIR_EN), ("H4", "hierarchy_interference", INTERFERENCE),
        *(("H5", f"rule_match:{k}", p) for k, p in rules.items()),
        ("H6", "invisible_control", CONTROLS), ("H6", "base64_like_surface", BASE64), ("H7", "url", URL), ("H7", "file_reference", FILES),
    ]


def axis_counts(text: Column, rules: dict[str, str] | None = None) -> dict[str, Column]:
    """Matches per axis."""
    out: dict[str, Column] = {a: F.lit(0) for a in AXES}
    for axis, _, p in _patterns(rules or {}):
        out[axis] = out[axis] + F.regexp_count(text, F.lit(p))
    return out


def observe(text: Column, rules: dict[str, str] | None = None) -> Column:
    """struct(mask, counts by axis, evidence array of (axis, code, matched), actions, targets, text_length, token_units); null text: empty."""
    text = F.coalesce(text, F.lit(""))
    counts = axis_counts(text, rules)
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _evidence(axis, code)) for axis, code, p in _patterns(rules or {})]
    every = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.struct(
        F.concat(*(F.when(counts[a] > 0, "1").otherwise("0") for a in AXES)).alias("mask"),
        F.struct(*(counts[a].cast("long").alias(a) for a in AXES)).alias("counts"),
        F.concat(*found).alias("evidence"),
        every(ACTION).alias("actions"), every(TARGET).alias("targets"),
        F.char_length(text).cast("long").alias("text_length"),
        F.regexp_count(text, F.lit(r"(?U)\S+|\s")).cast("long").alias("token_units"),
    )


def _evidence(axis: str, code: str):
    return lambda m: F.struct(F.lit(axis).alias("axis"), F.lit(code).alias("code"), m.alias("matched"))


def mask(text: Column, rules: dict[str, str] | None = None) -> Column:
    """One bit an axis; a pattern is searched for only until one of its axis is found."""
    text = F.coalesce(text, F.lit(""))
    some = {a: F.lit(False) for a in AXES}
    for axis, _, p in _patterns(rules or {}):
        some[axis] = some[axis] | text.rlike(p)
    return F.concat(*(F.when(x, "1").otherwise("0") for x in some.values()))
