"""Terms of the graph: prefixes, local names, identifiers and the rules that make them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where `oc:` terms live unless a caller says otherwise.
BASE = "http://example.org/ontology#"


def local_name(term: Column) -> Column:
    """What follows the last `#`, and in that the last `/`."""
    return F.substring_index(F.substring_index(term, "#", -1), "/", -1)


def compact(term: Column, base: str = BASE) -> Column:
    """`oc:` in place of the base; other terms as they are."""
    return F.when(F.startswith(term, F.lit(base)), F.concat(F.lit("oc:"), F.substr(term, F.lit(len(base) + 1)))).otherwise(term)


def expand(term: Column, base: str = BASE) -> Column:
    """The full form of an `oc:` or http(s) term; null for anything else, which is no state."""
    return F.when(F.startswith(term, F.lit("oc:")), F.concat(F.lit(base), F.substr(term, F.lit(4)))).when(term.rlike("^https?://"), term)


def skill_id(directory: Column) -> Column:
    """Identifier from a directory's name: lower case, blanks and underscores to hyphens, nothing else but letters and digits, 64 characters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(directory), "[\\s_]+", "-"), "[^a-z0-9-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "-+", "-"), "^-|-$", ""), 1, 64)


def frontmatter_name(name: Column) -> Column:
    """Identifier from a declared name: the first colon and anything unusual become hyphens; null for reserved names."""
    first = F.regexp_replace(F.concat_ws("-", F.substring_index(name, ":", 1), F.when(F.contains(name, F.lit(":")), F.substr(name, F.locate(":", name) + 1))), "[\\s_]+", "-")
    plain = F.regexp_replace(F.regexp_replace(F.lower(first), "[^a-z0-9-]", "-"), "-+", "-")
    out = F.substring(F.regexp_replace(plain, "^-|-$", ""), 1, 64)
    return F.when(~out.isin("index", ""), out)


def package_id(name: Column) -> Column:
    """Package from a name: the leading @ goes, each segment becomes a slug; `local` if nothing is left."""
    segments = F.transform(F.split(F.regexp_replace(name, "^@", ""), "/"), lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", ""))
    out = F.array_join(F.filter(segments, lambda s: s != ""), "/")
    return F.when(out == "", F.lit("local")).otherwise(out)


def skill_uri(qualified: Column) -> Column:
    """Node of a skill: `/@` and all but lower-case letters, digits and underscores become single underscores."""
    slug = F.regexp_replace(F.regexp_replace(F.replace(F.lower(qualified), F.lit("/@"), F.lit("_")), "[^a-z0-9_]", "_"), "_+", "_")
    return F.concat(F.lit("oc:skill_"), F.regexp_replace(slug, "^_|_$", ""))


def hashed_node(prefix: str, digits: int, *parts: Column) -> Column:
    """A node named by the SHA-256 of colon-joined parts: `req_`, `kn_`, `payload_` and content nodes."""
    return F.concat(F.lit(f"oc:{prefix}_"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, digits))


def snake(name: Column) -> Column:
    """CamelCase and any separators to snake_case."""
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def requirement_type(node_type: Column) -> Column:
    """What follows the last `Requirement`."""
    return F.substring_index(node_type, "Requirement", -1)


def valid_skill_id(name: Column) -> Column:
    """1 to 64 bytes of ASCII letters, digits, dot, underscore, slash and hyphen."""
    return name.rlike("^[A-Za-z0-9._/-]{1,64}$")


def import_slug(name: Column) -> Column:
    """Slug of an imported repository's name; `imported` if nothing is left."""
    out = F.regexp_replace(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")
    return F.when(out == "", F.lit("imported")).otherwise(out)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that cuts no character."""
    head = F.substring(text, 1, most)
    lengths = F.sequence(F.lit(0), F.least(F.length(head), F.lit(most)))
    keep = F.aggregate(lengths, F.lit(0), lambda best, n: F.when(F.octet_length(F.substr(head, F.lit(1), n)) <= most, n).otherwise(best))
    return F.when(F.octet_length(head) <= most, head).otherwise(F.substr(head, F.lit(1), keep))


def file_hash_31(name: Column) -> Column:
    """The 31-multiplier string hash, as a signed 32-bit number, of a text's characters."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
