"""Hint packs: rules that suggest a column's role by its name and values, check values, and look for leaks.

Rules are few and live on the driver; all their checks of a table run in one grouping of its distinct values.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T
from veilgrid.operators.profile import cells

MAX_BYTES, MAX_RULES = 1 << 20, 200
ROLES, EVIDENCE = "id qi sensitive keep".split(), ("name_and_value", "value", "name")


@dataclass(frozen=True)
class Rule:
    """names: normal column names; shape or check test values ({'set', 'range', 'luhn', 'my_number', 'email'}); suggest: a role and, for qi, generalizer settings."""

    id: str
    names: tuple[str, ...] = ()
    shape: str | None = None
    check: dict | None = None
    role: str | None = None
    gen: dict | None = None
    leak: bool = False
    pack: str = field(default="", compare=False)


def normal_name(name: str) -> str:
    return unicodedata.normalize("NFKC", name.strip()).lower().strip()


_AREAS = {
    "北海道・東北": "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県", "関東": "茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県",
    "中部": "新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県", "近畿": "三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県",
    "中国": "鳥取県 島根県 岡山県 広島県 山口県", "四国": "徳島県 香川県 愛媛県 高知県", "九州・沖縄": "福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県",
}
_PREFECTURES = {p: [area] for area, those in _AREAS.items() for p in those.split()}
BUILTIN = (
    Rule("person_name", ("name", "氏名", "名前", "full_name"), role="id"),
    Rule("email", ("email", "mail", "メール"), check={"email": True}, role="id", leak=True),
    Rule("phone", ("phone", "tel", "電話", "電話番号"), shape="0#{1,3}-#{2,4}-#{3,4}", role="id"),
    Rule("my_number", ("my_number", "個人番号"), check={"my_number": True}, role="id", leak=True),
    Rule("card", ("card", "card_number", "カード番号"), check={"luhn": True}, role="id", leak=True),
    Rule("postal", ("zip", "postal", "郵便番号"), shape="###-####", role="qi", gen={"type": "prefix", "length": 8}),
    Rule("prefecture", ("prefecture", "都道府県"), check={"set": [*_PREFECTURES]}, role="qi", gen={"type": "category", "hierarchy": _PREFECTURES}),
    Rule("age", ("age", "年齢"), check={"range": [0, 130]}, role="qi", gen={"type": "numeric", "widths": [10, 20, 100]}),
    Rule("birth_date", ("birth_date", "birthday", "生年月日"), shape="####-##-##", role="qi", gen={"type": "date"}),
    Rule("sex", ("sex", "gender", "性別"), check={"set": ["M", "F", "男", "女", "その他"]}, role="qi"),
    Rule("diagnosis", ("diagnosis", "disease", "診断", "病名"), role="sensitive"),
    Rule("income", ("income", "salary", "年収"), role="sensitive"),
)


def load_pack(data: bytes) -> list[Rule]:
    """JSON of {schema: 1, id, version, rules: [...]}; unknown keys, repeated ids and oversized packs are refused."""
    from veilgrid.sources.tables import load_json

    if len(data) > MAX_BYTES:
        raise ValueError("the pack is too large")
    obj = load_json(data.decode("utf-8"))
    if set(obj) != {"schema", "id", "version", "rules"} or obj["schema"] != 1 or len(obj["rules"]) > MAX_RULES:
        raise ValueError("not a hint pack")
    out = []
    for r in obj["rules"]:
        if set(r) - {"id", "names", "shape", "check", "role", "gen", "leak"} or "id" not in r or r.get("role", "qi") not in ROLES:
            raise ValueError(f"not a rule: {json.dumps(r.get('id'), ensure_ascii=False)}")
        if r.get("shape"):
            T.compile_shape(r["shape"])
        out.append(Rule(**{**r, "names": tuple(map(normal_name, r.get("names", ()))), "pack": obj["id"]}))
    if len({r.id for r in out}) < len(out):
        raise ValueError("a rule's id repeats")
    return out


def merged(*packs: list[Rule]) -> list[Rule]:
    out: dict[str, Rule] = {}
    for pack in packs:
        for r in pack:
            if r.id in out:
                raise ValueError(f"a rule's id repeats: {r.id}")
            out[r.id] = r
    return list(out.values())


def _holds(rule: Rule, v: Column) -> Column:
    """true, false, or null where the value can't be checked."""
    if rule.shape:
        return v.rlike(T.compile_shape(rule.shape))
    if not rule.check:
        return F.lit(None).cast("boolean")
    ((kind, arg),) = rule.check.items()
    plain = F.replace(v, F.lit("-"), F.lit(""))
    return {
        "set": lambda: v.isin(list(arg)), "range": lambda: v.try_cast("decimal(38,10)").between(*arg), "luhn": lambda: T.luhn_ok(plain),
        "my_number": lambda: T.my_number_ok(plain), "email": lambda: v.rlike("^(?:" + T.EMAIL + r")\z"),
    }[kind]()


def scan(df: DataFrame, rules=BUILTIN, columns: list[str] | None = None) -> DataFrame:
    """column, rule, by_name, match, mismatch, cannot_check: for every rule whose name fits or which some value matches."""
    columns = columns or df.columns
    v = cells(df, columns).where("value <> ''").groupBy("column", T.strip(F.col("value")).alias("v")).agg(F.count("*").alias("n"))
    n, aggs = F.col("n"), []
    for i, r in enumerate(rules):
        ok = _holds(r, F.col("v"))
        state = lambda test, i=i: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
        aggs += [state(ok).alias(f"m{i}"), state(~ok).alias(f"x{i}"), state(ok.isNull()).alias(f"c{i}")]
    wide = v.groupBy("column").agg(*aggs)
    names = {c: normal_name(c) for c in columns}
    fits = F.create_map(*(x for c in columns for x in (F.lit(c), F.array(*(F.lit(names[c] in r.names) for r in rules)))))
    rows = wide.withColumn("fits", F.element_at(fits, F.col("column")))
    rows = rows.select("column", F.inline(F.array(*(F.struct(F.lit(r.id).alias("rule"), F.col("fits")[i].alias("by_name"), F.col(f"m{i}").alias("match"), F.col(f"x{i}").alias("mismatch"), F.col(f"c{i}").alias("cannot_check")) for i, r in enumerate(rules)))))
    return rows.where("by_name OR match > 0")


def candidates(found: DataFrame, rules=BUILTIN) -> DataFrame:
    """column, rule, role, evidence (name_and_value, value, name), rank: a value speaks if most of those checked match."""
    from pyspark.sql import Window as W

    role = F.create_map(*(x for r in rules for x in (F.lit(r.id), F.lit(r.role))))
    fits = (F.col("match") > 0) & (F.col("match") >= 9 * F.col("mismatch"))
    evidence = F.when(F.col("by_name") & fits, EVIDENCE[0]).when(fits, EVIDENCE[1]).when(F.col("by_name") & (F.col("mismatch") == 0), EVIDENCE[2])
    c = found.select("column", "rule", F.element_at(role, F.col("rule")).alias("role"), evidence.alias("evidence")).where("evidence IS NOT NULL AND role IS NOT NULL")
    order = lambda col, names: F.array_position(F.array(*map(F.lit, names)), F.col(col))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(order("evidence", EVIDENCE), order("role", ROLES), "rule")))


def role_mismatches(found: DataFrame, roles: dict[str, str], rules=BUILTIN) -> DataFrame:
    """column, declared, suggested: an identifier kept in the open, or a quasi-identifier kept or called sensitive."""
    best = candidates(found, rules).where("rank = 1")
    declared = F.element_at(F.create_map(*(x for c, r in roles.items() for x in (F.lit(c), F.lit(r)))), F.col("column"))
    c = best.withColumn("declared", declared)
    qi = (F.col("role") == "qi") & F.col("evidence").isin(*EVIDENCE[:2]) & F.col("declared").isin("keep", "sensitive")
    ident = (F.col("role") == "id") & (F.col("evidence") == EVIDENCE[0]) & F.col("declared").isin("keep", "qi", "sensitive")
    return c.where(qi | ident).select("column", "declared", F.col("role").alias("suggested"))


def provisional_roles(found: DataFrame, columns: list[str], rules=BUILTIN) -> dict[str, str]:
    """The first candidate's role for each column, else keep."""
    best = {r["column"]: r["role"] for r in candidates(found, rules).where("rank = 1").collect()}  # a row a column
    return {c: best.get(c, "keep") for c in columns}
