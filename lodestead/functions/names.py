"""Name columns: normal form, first and last token, nickname groups, digests, partial dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formal given names and their short forms.
NICKNAMES = {
    "Patricia": ["Pat", "Patty", "Patsy", "Tricia", "Trish"],
    "William": ["Bill", "Billy", "Will", "Willy", "Liam"],
    "Robert": ["Bob", "Bobby", "Rob", "Robbie"],
    "Richard": ["Rick", "Ricky", "Rich", "Dick"],
    "James": ["Jim", "Jimmy", "Jamie"],
    "John": ["Jack", "Johnny"],
    "Michael": ["Mike", "Mikey", "Mick"],
    "Joseph": ["Joe", "Joey"],
    "Steven": ["Steve"],
    "Stephen": ["Steve"],
    "Elizabeth": ["Liz", "Lizzy", "Beth", "Betty", "Eliza"],
    "Margaret": ["Maggie", "Meg", "Peggy", "Marge"],
    "Catherine": ["Cathy", "Kate", "Katie", "Kitty"],
    "Dorothy": ["Dot", "Dottie", "Dolly"],
    "Barbara": ["Barb", "Babs", "Bobbie"],
    "Susan": ["Sue", "Susie", "Suzy"],
    "Jennifer": ["Jen", "Jenny"],
    "Jessica": ["Jess", "Jessie"],
    "Christopher": ["Chris"],
    "Matthew": ["Matt"],
    "Anthony": ["Tony"],
    "Daniel": ["Dan", "Danny"],
    "David": ["Dave", "Davey"],
    "Donald": ["Don", "Donny"],
    "Thomas": ["Tom", "Tommy"],
    "Charles": ["Charlie", "Chuck", "Chas"],
    "Kenneth": ["Ken", "Kenny"],
    "Edward": ["Ed", "Eddie", "Ted", "Teddy"],
    "Ronald": ["Ron", "Ronnie"],
    "George": ["Georgie"],
    "Timothy": ["Tim", "Timmy"],
    "Gregory": ["Greg"],
    "Lawrence": ["Larry"],
    "Gerald": ["Jerry", "Gerry"],
    "Raymond": ["Ray"],
    "Dennis": ["Denny"],
    "Walter": ["Walt", "Wally"],
    "Douglas": ["Doug"],
    "Reginald": ["Reg", "Reggie"],
    "Terrence": ["Terry"],
    "Maxine": ["Max"],
}
# End of fixed values.


def squeeze(c: Column) -> Column:
    """Blanks (of any script) collapsed to one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def normalize_name(c: Column) -> Column:
    """Without dotted initials, doubled blanks and one generational suffix; lower case."""
    bare = squeeze(F.regexp_replace(c, r"(?U)\b[A-Z]\.\s*", ""))
    return F.trim(F.lower(F.regexp_replace(bare, r"(?i)\s+(Jr|Sr|II|III|IV)\.?$", "")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def first_token(c: Column) -> Column:
    """The first token of the name as written; empty if there is none."""
    return F.coalesce(F.try_element_at(tokens(c), F.lit(1)), F.lit(""))


def last_token(c: Column) -> Column:
    """The last token of the name as written; empty if there are fewer than two."""
    return F.when(F.size(tokens(c)) >= 2, F.element_at(tokens(c), -1)).otherwise(F.lit(""))


def nickname_frame(spark: SparkSession, entries: dict[str, list[str]] | None = None) -> DataFrame:
    """``formal``, ``alias`` pairs of a nickname dictionary (the built-in one by default)."""
    pairs = [(f, a) for f, short in (NICKNAMES if entries is None else entries).items() for a in short]
    return spark.createDataFrame(pairs, "formal string, alias string")


def nickname_groups(first: Column, entries: dict[str, list[str]] | None = None) -> Column:
    """The entries a given name belongs to, as formal or short form, in lower case.

    A dictionary is a bounded dimension, so it is a map literal in the plan.
    Two names are nicknames of each other if these arrays overlap; a name of the
    dictionary so matches itself, and entries don't chain through a shared alias.
    """
    groups: dict[str, list[str]] = {}
    for formal, short in (NICKNAMES if entries is None else entries).items():
        for n in dict.fromkeys([formal.lower(), *(s.lower() for s in short)]):
            groups.setdefault(n, []).append(formal.lower())
    none = F.array().cast("array<string>")
    if not groups:
        return none
    table = F.create_map(*[x for n, g in groups.items() for x in (F.lit(n), F.array(*map(F.lit, g)))])
    return F.coalesce(F.try_element_at(table, F.lower(first)), none)


def digest(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex: the key of addresses, contents and prompts."""
    return F.sha2(c, 256)


def partial_date(dateval: Column) -> Column:
    """ISO text of [day, month, year], as far as it is known; zero or missing parts are unknown, no year is null."""
    d, m, y = (F.nullif(F.try_element_at(dateval, F.lit(k)), F.lit(0)) for k in (1, 2, 3))
    month = F.format_string("%04d-%02d", y, m)
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.concat(month, F.lit("-"), F.lpad(d.cast("string"), 2, "0"))).when(
        y.isNotNull() & m.isNotNull(), month).when(y.isNotNull(), F.format_string("%d", y))
