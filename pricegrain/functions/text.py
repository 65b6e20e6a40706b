"""Names and descriptions as Column expressions: folding, tokens, similarity, abbreviations, chains, sections.

Everything is built from Spark's own functions, so it stays in generated code. Comparisons ignore case, accents and
trailing blanks, through fold().
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count in names.
STOP_WORDS = ("de", "do", "da", "dos", "das", "com", "sem", "e", "para", "a", "o", "em", "no", "na", "ao")

# Broad targets, and the terms that stand for them.
SYNONYMS = {
    "bebida alcoolica": ("alcoolic", "garrafeira", "vinho", "cerveja", "whisky", "gin", "vodka", "licor", "espumante", "aguardente", "porto", "sidra", "martini", "sangria"),
    "alcool": ("alcoolic", "garrafeira", "vinho", "cerveja", "whisky", "gin", "vodka", "licor", "espumante", "aguardente", "porto", "sidra"),
    "limpeza": ("limpeza", "detergente", "lixivia", "sabao", "amaciador"),
    "higiene": ("higiene", "champo", "gel de banho", "sabonete", "pasta de dentes", "escova", "cosmetic"),
    "laticinios": ("laticinio", "leite", "iogurte", "queijo", "manteiga", "natas", "requeijao"),
    "pastelaria": ("pastelaria", "padaria", "bolo", "napolitana", "croissant", "folhado", "queque", "pao de deus"),
}

# Abbreviations on receipts and what they stand for, in the order in which they are replaced. Those that end
# with a slash take the blanks behind it along; all others are whole words.
ABBREVIATIONS = (
    ("BOL", "Bolacha"),
    ("BOLACH", "Bolacha"),
    ("QJ", "Queijo"),
    ("IOG", "Iogurte"),
    ("MANT", "Manteiga"),
    ("CEREA(?:IS|TS)", "Cereais"),
    ("LOMB", "Lombinhos"),
    ("FRANG", "Frango"),
    ("NAT", "Natas"),
    ("CONSERVACA[OD]", "Conservação"),
    ("DESIDRAT", "Desidratado"),
    ("SELECÇÃO", "Seleção"),
    ("C/", "com "),
    ("S/", "sem "),
    ("P/", "para "),
    ("EMB", "Embalagem"),
    ("UN", "unidades"),
)
# Chains as they are printed in descriptions.
CHAIN_TOKENS = ("CNT", "CONTINENTE", "PD", "PINGO DOCE", "MERC", "MERCADONA", "LIDL", "ALDI")
# Chains that are supermarkets.
SUPERMARKETS = ("continente", "pingo doce", "mercadona", "aldi", "lidl", "minipreço", "minipreco", "intermarché", "intermarche", "auchan", "jumbo", "el corte inglés")
# Shop sections and the parts of a category that lead to them, in order.
SECTIONS = (
    ("Frutas e Legumes", ("fruta", "legume", "hort")),
    ("Padaria", ("pao", "padaria", "pastelaria")),
    ("Talho", ("talho", "carne")),
    ("Charcutaria", ("charcut", "enchido", "fiambre", "presunto")),
    ("Peixaria", ("peixe", "marisco", "peixaria")),
    ("Laticínios", ("latic", "queijo", "iogurte")),
    ("Ovos", ("ovo",)),
    ("Congelados", ("congel",)),
    ("Bebidas", ("bebida",)),
    ("Higiene", ("higiene",)),
    ("Limpeza", ("limpeza", "detergente")),
    ("Mercearia", ("mercearia", "doce", "snack", "cereal")),
)
# Sections in the order of the aisles.
AISLES = ("Frutas e Legumes", "Padaria", "Talho", "Charcutaria", "Peixaria", "Laticínios", "Ovos", "Congelados", "Mercearia", "Bebidas", "Higiene", "Limpeza", "Outros")

#: A word boundary as ASCII sees it, whatever the regex engine's flags.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letters; the combining marks follow, which translate() then drops."""
    pairs = {}
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(letter) == len(bare) == 1 and letter != bare and bare.isascii():
            pairs[letter] = bare
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


MARKED, BARE = _accents()


def fold_text(value: str) -> str:
    """fold() for an argument."""
    return "".join(c for c in unicodedata.normalize("NFD", str(value).lower()) if not unicodedata.combining(c)).strip()


def fold(x: Column) -> Column:
    """Lower case, without accents and outer blanks."""
    return F.trim(F.translate(F.lower(x), MARKED, BARE))


def contains_pattern(value: str) -> str:
    """The LIKE pattern of a search; % and _ in it stay wildcards."""
    return f"%{fold_text(value)}%"


def normal_name(x: Column) -> Column:
    """fold(), with only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def tokens(x: Column) -> Column:
    """Words of a name that count."""
    return F.filter(F.split(normal_name(x), " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def dice_of(a: Column, b: Column) -> Column:
    """Dice coefficient of two token arrays, as sets; 0 if either is empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def similarity_of(a: Column, b: Column) -> Column:
    """Dice; at least 0.95 if one token list of two different tokens or more is within the other and both begin alike."""
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    within = (F.size(F.array_except(small, large)) == 0) & (F.size(F.array_distinct(small)) >= 2) & (F.try_element_at(small, F.lit(1)) == F.try_element_at(large, F.lit(1)))
    return F.when(within, F.greatest(dice_of(a, b), F.lit(0.95))).otherwise(dice_of(a, b))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of(tokens(a), tokens(b))


def character_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of names without spaces; 0 if both are empty."""
    x, y = F.replace(normal_name(a), F.lit(" "), F.lit("")), F.replace(normal_name(b), F.lit(" "), F.lit(""))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 0.0).otherwise(1.0 - F.levenshtein(x, y) / longer)


def term_similarity(term: Column, name: Column) -> Column:
    """The largest character ratio of a term with a name or any of its tokens."""
    word = F.replace(normal_name(term), F.lit(" "), F.lit(""))
    ratio = lambda t: F.when(F.greatest(F.length(word), F.length(t)) == 0, 0.0).otherwise(1.0 - F.levenshtein(word, t) / F.greatest(F.length(word), F.length(t)))
    return F.greatest(character_ratio(term, name), F.coalesce(F.array_max(F.transform(tokens(name), ratio)), F.lit(0.0)))


def expand_target(target: str) -> list[str]:
    """Search terms for a target: those of the first broad target that holds it or is held by it, else the target itself."""
    folded = fold_text(target)
    for key, terms in SYNONYMS.items():
        if key in folded or folded in key:
            return list(terms)
    return [str(target).strip()]


def expand_abbreviations(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for pattern, meaning in ABBREVIATIONS:
        out = F.regexp_replace(out, f"(?iu){BEFORE}{pattern}" + (r"\s*" if pattern.endswith("/") else AFTER), meaning)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def split_chain(x: Column) -> Column:
    """struct(text without chain tokens, first chain token in upper case or null)."""
    text = F.coalesce(x, F.lit(""))
    pattern = f"(?i){BEFORE}({'|'.join(CHAIN_TOKENS)}){AFTER}"
    found = F.nullif(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return F.struct(F.trim(F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\s+", " ")).alias("sem_cadeia"), found.alias("cadeia_token"))


def store_kind(chain: Column, name: Column) -> Column:
    """supermercado, farmacia or outro."""
    c, n = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (chain, name))
    pharmacy = "farm[aá]cia"
    named = F.exists(F.array(*map(F.lit, SUPERMARKETS)), lambda s: n.contains(s))
    return F.when(c.isin(*SUPERMARKETS) | named, "supermercado").when(c.rlike(pharmacy) | n.rlike(pharmacy), "farmacia").otherwise("outro")


def section(category: Column, folds: bool = True) -> Column:
    """The shop section of a category; without `folds` only the accent of "pão" is understood."""
    c = fold(category) if folds else F.lower(category)
    out = F.lit(None).cast("string")
    for name, parts in reversed(SECTIONS):
        parts = (*parts, "pão") if name == "Padaria" else parts
        hit = c.contains(parts[0])
        for part in parts[1:]:
            hit = hit | c.contains(part)
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.when(F.coalesce(category, F.lit("")) == "", "Outros").otherwise("Mercearia"))


def aisle(name: Column) -> Column:
    """Place of a section among the aisles, from 0; 99 for any other."""
    return F.when(name.isin(*AISLES), F.array_position(F.array(*map(F.lit, AISLES)), name) - 1).otherwise(99).cast("int")
