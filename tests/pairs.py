"""Labelled pairs of names: hand-written ones, and generated ones with a seed."""

import itertools
import random
from decimal import Decimal

#: Own names. A unit counts as a whole word behind its number, not as the beginning of another word, and a weight or a
#: volume that is part of a concentration isn't the product's own.
HAND = {
    "weight": [
        ("Мука 25г", "Мука 25 гр.", True), ("Мука 25грамм", "Мука 25gr", True), ("Соль 2кг", "Соль 2000 г", True), ("Мука 25г", "Торт 25 гостям", False),
        ("Мука 25г", "Garland 25 glows", False), ("Мука 25г", "Player 25gramophone", False), ("Мука 25мкг", "Box of 25 umbrellas", False),
        ("Сироп 25мг", "Сироп 25мг/2мл", False), ("Сироп 25г", "Сироп 25g\\2ml", False), ("Сироп 25мкг", "Сироп 25мкг/мл", False), ("Соль 2кг", "Соль 2кг/1л", False),
    ],
    "volume": [
        ("Квас 7 литров", "Квас 7 liters", True), ("Квас 3л", "Квас 3000 мл", True), ("Квас 7 литров", "Ветка 7 листьев", False), ("Квас 7 литров", "Lamp 7 lumens", False),
        ("Капли 3 мл", "Капли 1мг/3мл", False), ("Капли 3 мл", "Капли 1мг \\3мл", False),
    ],
    "quantity": [
        ("Салфетки 40шт", "Салфетки N40", True), ("Салфетки №40", "Салфетки 40 шт", True), ("Салфетки 40шт", "Салфетки 40", False),
        ("Салфетки 40шт", "Ткань 40 штрихов", False), ("Салфетки 40шт", "Клетка 40 уплотнителей", False),
    ],
    "memory": [("Диск 3тб", "Диск 3000 гб", True), ("Диск 3тб", "Диск 3000000 mb", True), ("Диск 3тб", "Диск 3гб", False)],
    "dose": [("Спрей 250мг/доза", "Спрей 0.25г/доза", True), ("Спрей 251мг\\доза", "Спрей 0.25г/доза", False)],
    "length": [("Шнур 7м", "Шнур 700см", True), ("Шнур 7м", "Шнур 7км", False), ("Шнур 7м", "Шнур 7mm", False)],
}
COMPLEX = [
    ("Ковёр 2м х 3м", "Ковёр 200см х 300см", True), ("Ковёр 2м х 3м", "Ковёр 2см х 3см", False), ("Коробка 30см х 40см", "Коробка 30х40", True),
    ("Коробка 30см х 40см", "Коробка 31х40", False), ("Коробка 30см х 40см", "Коробка 30х41", False), ("Мазь 3г/мл", "Мазь 3000мг/мл", True),
    ("Мазь 50мг/мл", "Мазь 0.05г/мл", True), ("Мазь 5%", "Мазь 50мг/мл", True), ("Мазь 3%", "Мазь 0.03г/мл", True), ("Мазь 30мг/10мл", "Мазь 15мг/5мл", True),
]
#: Relative weight (smallest unit: largest number), some designations of each unit, and a name.
NUMERIC = {
    "weight": ([(10**9, "мкг ug"), (10**6, "мг mg"), (1000, "гр g"), (1, "кг kg")], "Мука"),
    "volume": ([(1000, "мл ml"), (1, "л литров l")], "Квас"),
    "memory": ([(10**9, "kb кб"), (10**6, "mb мб"), (1000, "gb гб"), (1, "tb тб")], "Диск"),
    "dose": ([(10**6, "мкг/доза мкг\\сут"), (1000, "мг/доза мг\\сут"), (1, "г/доза г\\сут")], "Спрей"),
    "length": ([(10**6, "мм mm"), (10**5, "см cm"), (1000, "м m"), (1, "км km")], "Шнур"),
}


def shown(number: Decimal) -> str:
    text = f"{number:.20f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def numeric_pairs(measure: str, seed: int = 7) -> list[tuple[str, str, bool]]:
    """All pairs of one quantity and of its thousandth, each in every unit: equal if the quantity is."""
    rng, records = random.Random(seed), []
    units, name = NUMERIC[measure]
    for part in (Decimal(1), Decimal(7)):
        for weight, words in units:
            for word in words.split():
                records.append((f"{name} {shown(part * weight)}{' ' * rng.randint(0, 3)}{word}", part))
    return [(a, b, p == r) for (a, p), (b, r) in itertools.product(records, records)]


def colour_pairs() -> list[tuple[str, str, bool]]:
    records = [(f"{name} {w}", k) for k, words in enumerate((("красн", "red"), ("син", "blue"), ("зелен", "green"))) for w in words for name in ("Кружка", "Плед")]
    return [(a, b, x == y) for (a, x), (b, y) in itertools.product(records, records)]


def similarity_pairs(k: int = 3528, seed: int = 7) -> list[tuple[str, str, bool]]:
    """Equal: the same thing, finish and maker, whatever the extra word. As many unequal as equal pairs."""
    things = "Чайник Кастрюля Сковорода Половник Тостер Миксер Дуршлаг".split()
    finishes = "матовый стальной эмалированный керамический чугунный прозрачный бамбуковый".split()
    makers = "уральский балтийский норвежский марокканский корейский бразильский тульский фарерский".split()
    extras = "новинка акция подарок".split()
    rng = random.Random(seed)
    kinds = list(itertools.product(things, finishes, makers))
    equal = [(f"{f} {c} {o} {a}", f"{f} {c} {o} {b}", True) for f, c, o in kinds for a, b in itertools.product(extras, extras)]
    equal = rng.sample(equal, min(k, len(equal)))
    unequal = set()
    while len(unequal) < len(equal):
        x, y = rng.sample(kinds, 2)
        unequal.add((" ".join([*x, rng.choice(extras)]), " ".join([*y, rng.choice(extras)]), False))
    return equal + sorted(unequal)
