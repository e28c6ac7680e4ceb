"""Measure and similarity rules: shipped values, loading from JSON, and their compiled form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from decimal import Decimal

# Fixed values of the shipped rules. Each unit: name, symbol expression, relative weight, prefix, postfix, search mode;
# "common" takes the measure's own prefix or postfix.
NUMERIC_MEASURES = [
    {"name": "Объем", "prefix": r"[^\\\/а-яa-z0-9]", "postfix": "", "merge_mode": "1", "units": [
        ("Миллилитр", "мл|миллилитр(?:ов)?|ml|milliliters?|millilitres?", 1, "common", "common", "behind"),
        ("Литр", "литр(?:ов)?|л|l|litres?|liters?", 1000, "common", "[^а-яa-z]", "behind"),
    ]},
    {"name": "Вес", "prefix": "[^0-9]", "postfix": r"[^\\\/]", "merge_mode": "1", "units": [
        ("Микрограмм", "мкг|микрограмм|µg|ug|microgram", 1, "common", r"[^\\\/a-z]", "behind"),
        ("Миллиграмм", "мг|миллиграмм|mg|milligram", 1000, "common", "common", "behind"),
        ("Грамм", "г|гр|г[.]|грамм|g|gr|gram", 1000000, "common", r"[^\\\/a-zа-я]", "behind"),
        ("Килограмм", "кг|килограмм|kg|kilogram", 1000000000, "common", "common", "behind"),
    ]},
    {"name": "Количество", "prefix": "[^0-9]", "postfix": "[^а-я]", "merge_mode": "1", "exclude": True, "special_value_search": r"([2-9][,.]?\d*|[1-9]\d+[,.]?\d*)", "units": [
        ("Штуки", "шт|уп|пач|штук|упак|упаковок|пачек", 1, "common", "common", "behind"),
        ("Номера", r"№|\sn|\s[xх]", 1, "", "[^0-9]", "front"),
    ]},
    {"name": "Объем памяти", "prefix": "[^0-9]", "postfix": "", "merge_mode": "1", "units": [
        ("Килобайт", "kb|kilobyte|килобайт|кб", 1, "common", "common", "behind"),
        ("Мегабайт", "mb|megabyte|мегабайт|мб", 1000, "common", "common", "behind"),
        ("Гигабайт", "gb|gigabyte|гигабайт|гб", 1000000, "common", "common", "behind"),
        ("Террабайт", "tb|terabyte|терабайт|тб", 1000000000, "common", "common", "behind"),
    ]},
    {"name": "Концентрация на дозу", "prefix": "[^0-9]", "postfix": "", "merge_mode": "1", "units": [
        ("Микрограмм на дозу", r"мкг[\\\/](?:доз|сут)", 1, "common", "common", "behind"),
        ("Миллиграмм на дозу", r"мг[\\\/](?:доз|сут)", 1000, "common", "common", "behind"),
        ("Грамм на дозу", r"г[\\\/](?:доз|сут)", 1000000, "common", "common", "behind"),
    ]},
    {"name": "Длина", "prefix": "[^0-9]", "postfix": "", "merge_mode": "1", "units": [
        ("Миллиметр", "мм|миллиметр|mm|millimeter", 1, "common", "common", "behind"),
        ("Сантиметр", "см|сантиметр|centimeter|cm", 10, "[^0-9.]", "common", "behind"),
        ("Метр", r"м\s|метр|m\s|meter", 1000, "common", "common", "behind"),
        ("Километр", "км|километр|km|kilometer", 1000000, "common", "common", "behind"),
    ]},
]
STRING_MEASURES = [
    {"name": "Цвет", "units": [
        ("Цвет Черный", "black|ч[её]рн"),
        ("Цвет Белый", "white|бел"),
        ("Цвет Синий", "blue|син"),
        ("Цвет Зеленый", "green|зелен"),
        ("Цвет Красный", "red|красн"),
        ("Цвет Желтый", "yellow|ж[её]лт"),
        ("Цвет Коричневый", "brown|коричн"),
    ]},
    {"name": "Лекарственная Форма", "use_it": False, "units": [
        ("Таблетка", "таб|тб[.]|тб\b|тбл"),
        ("Драже", "драж|др[.]"),
        ("Гранула", "гран"),
        ("Порошок", "порош"),
        ("Капсула", "капс"),
        ("Сбор", "сбор"),
        ("Карамель", "карам"),
        ("Карандаш", "каранд"),
        ("Крем", "крем"),
        ("Мазь", "мазь"),
        ("Гель", "гель"),
        ("Суппозитории", "супп|свеч"),
        ("Паста", "паст"),
        ("Капли", "кап.|кап\b|капл"),
        ("Настойка", "наст"),
        ("Сироп", "сироп"),
        ("Суспензия", "сусп"),
        ("Эмульсия", "эмул"),
    ]},
]
#: Complex features and their priorities; all other features have priority 10.
COMPLEX_MEASURES = {"Complex Dimension": 1, "Complex Concentration": 2}
PLAIN_PRIORITY = 10
#: Fixed values of the shipped similarity rules.
SIMILARITY = {
    "word_min_lenght": 2,
    "regex_weights": {"caps": 1, "capital": 1, "low": 1, "other": 1},
    "language_weights": {"rus": 1, "eng": 1},
    "ratio": {"min_ratio": 0.1, "max_ratio": 0.2, "min_appearance": 2, "min_appearance_penalty": 0, "rate_func": "sqrt2"},
}

VALUE = r"\d*[.,]?\d+"
MODES = {"strict", "modest", "client", "source"}


@dataclass(frozen=True)
class Unit:
    name: str
    symbol: str
    weight: int
    prefix: str = ""
    postfix: str = ""
    search_mode: str = "behind"
    max_count: int | None = 1
    value: str = VALUE  # expression of a number; empty for string units

    @property
    def search(self) -> str:
        """The expression that finds the unit with a value."""
        if self.search_mode == "front":
            return rf"{self.prefix}(?:{self.symbol})\s*{self.value}{self.postfix}"
        return rf"{self.prefix}{self.value}\s*(?:{self.symbol}){self.postfix}"

    @property
    def group(self) -> int:
        """1 if the value's own group is what a search returns."""
        return 1 if self.value.startswith("(") else 0

    def exactly(self) -> tuple[str, str]:
        """What stands before and after a number in the expression that accepts it in this unit."""
        if self.search_mode == "front":
            return rf"{self.prefix}(?:{self.symbol})\s*", self.postfix
        return self.prefix, rf"\s*(?:{self.symbol}){self.postfix}"


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str  # numeric, string or complex
    units: tuple[Unit, ...] = ()
    merge_mode: str = "overall"
    exclude: bool = False
    in_regexes: bool = True
    in_features: bool = True
    validation_mode: str = "strict"
    not_found_mode: str = "strict"
    priority: int = PLAIN_PRIORITY

    def allied(self, unit: Unit) -> list[Unit]:
        """The unit and those its values are also looked for in: none, all, or so many neighbours by weight."""
        units = sorted(self.units, key=lambda u: u.weight)
        at = units.index(unit)
        if self.merge_mode == "none":
            return [unit]
        if self.merge_mode.isnumeric():
            n = int(self.merge_mode)
            return [unit, *units[max(0, at - n) : at], *units[at + 1 : at + 1 + n]]
        return [unit, *units[:at], *units[at + 1 :]]


@dataclass(frozen=True)
class MeasureRules:
    measures: tuple[Measure, ...] = field(default_factory=tuple)

    def for_regexes(self) -> list[Measure]:
        return [m for m in self.measures if m.in_regexes and m.kind != "complex"]

    def for_features(self) -> list[Measure]:
        """By ascending priority; equal ones in the order of the rules."""
        return sorted((m for m in self.measures if m.in_features), key=lambda m: m.priority)

    def merged(self, mode: str) -> MeasureRules:
        """The rules with another merge mode for numeric measures."""
        return MeasureRules(tuple(replace(m, merge_mode=mode) if m.kind == "numeric" else m for m in self.measures))


def shipped_rules() -> MeasureRules:
    found = []
    for m in NUMERIC_MEASURES:
        own = {"common": None}
        units = tuple(
            Unit(n, s, w, m["prefix"] if p in own else p, m["postfix"] if q in own else q, mode, 1, m.get("special_value_search", VALUE))
            for n, s, w, p, q, mode in m["units"]
        )
        found.append(Measure(m["name"], "numeric", units, m["merge_mode"], m.get("exclude", False)))
    for m in STRING_MEASURES:
        on = m.get("use_it", True)
        units = tuple(Unit(n, s, 1, value="") for n, s in m["units"])
        found.append(Measure(m["name"], "string", units, "none", False, on, on))
    found += [Measure(n, "complex", priority=p) for n, p in COMPLEX_MEASURES.items()]
    return MeasureRules(tuple(found))


def load_measure_rules(text: str) -> MeasureRules:
    """Rules from JSON. Groups, measures, modules and units that are switched off are skipped."""
    data, found = json.loads(text), []
    for kind in ("numeric", "string", "complex"):
        group = data.get(f"{kind}_measures", {})
        if not group.get("use_it", True):
            continue
        for m in group.get("measures", []):
            features, regexes = m.get("FeatureFlow", {}), m.get("SemantiX", {})
            for key in ("validation_mode", "not_found_mode"):
                if features.get(key, "strict") not in MODES:
                    raise ValueError(f"{m['measure_name']}: unknown {key} {features[key]!r}")
            found.append(
                Measure(
                    m["measure_name"],
                    kind,
                    _units(m["measure_data"], kind) if kind != "complex" else (),
                    _merge_mode(regexes.get("merge_mode", "overall")),
                    bool(regexes.get("exclude_rx")),
                    bool(regexes.get("use_it", kind != "complex")),
                    bool(features.get("use_it", True)),
                    features.get("validation_mode", "strict"),
                    features.get("not_found_mode", "strict"),
                    int(features.get("priority", PLAIN_PRIORITY)),
                )
            )
    return MeasureRules(tuple(found))


def _merge_mode(mode: object) -> str:
    mode = str(mode).lower()
    return mode if mode in ("none", "overall") or mode.isnumeric() else "overall"


def _units(data: dict, kind: str) -> tuple[Unit, ...]:
    def own(unit: dict, key: str):
        return data[f"common_{key}"] if unit[key] == "common" else unit[key]

    value = (data.get("special_value_search") or VALUE) if kind == "numeric" else (data.get("special_value_search") or "")
    return tuple(
        Unit(u["unit_name"], u["symbol"], u["relative_weight"], own(u, "prefix"), own(u, "postfix"), "front" if str(u["search_mode"]).lower() == "front" else "behind", own(u, "max_count"), value)
        for u in data["units"]
        if u.get("use_it", True)
    )


@dataclass(frozen=True)
class SimilarityRules:
    word_min_length: int = 2
    class_weights: tuple[tuple[str, float], ...] = (("caps", 1), ("capital", 1), ("low", 1), ("other", 1))
    language_weights: tuple[tuple[str, float], ...] = (("rus", 1), ("eng", 1))
    min_ratio: float = 0.1
    max_ratio: float = 0.2
    min_appearance: int = 2
    min_appearance_penalty: float = 0
    rate_function: str = "sqrt2"
    symbols: str = ""  # may stand inside words, not first
    word_boundary: bool = True
    custom_boundary: str = ""  # an expression that must match on either side of a word


def load_similarity_rules(text: str | None = None) -> SimilarityRules:
    data = json.loads(text) if text else SIMILARITY
    r = data["ratio"]
    return SimilarityRules(data["word_min_lenght"], tuple(data["regex_weights"].items()), tuple(data["language_weights"].items()), r["min_ratio"], r["max_ratio"], r["min_appearance"], r["min_appearance_penalty"], r["rate_func"], data.get("symbols", ""), data.get("word_boundary", True), data.get("custom_boundary", ""))


def ratio(own: int, other: int) -> Decimal:
    """own / other to twelve places."""
    return (Decimal(own) / Decimal(other)).quantize(Decimal(1).scaleb(-12)).normalize()
