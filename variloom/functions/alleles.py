"""Column builders for genotypes and alleles.

A genotype is an array of allele numbers (0 the reference, -1 missing); alleles are strings.
All are built-in expressions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variant types in order of precedence, the later winning over the earlier.
TYPES = ("UNCHANGED", "SNP", "MNP", "DELETION", "INSERTION", "INDEL", "SV_BREAKEND", "SV_SYMBOLIC", "SV_MISSING")
INDEL_TYPES = ("DELETION", "INSERTION", "INDEL")


def split_gt(gt: Column) -> Column:
    """Allele numbers of genotype text such as ``0/1`` or ``.|2``; null for null or empty text."""
    return F.when(F.length(gt) > 0, F.transform(F.split(gt, r"[/|]"), lambda a: F.when(a == ".", F.lit(-1)).otherwise(a.cast("int"))))


def join_gt(alleles: Column, phased: Column) -> Column:
    """Text of a genotype; the inverse of ``split_gt``."""
    parts = F.transform(alleles, lambda a: F.when(a < 0, F.lit(".")).otherwise(a.cast("string")))
    return F.when(phased, F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))


def is_phased(gt: Column) -> Column:
    return F.contains(gt, F.lit("|"))


def is_missing(alleles: Column) -> Column:
    return F.forall(alleles, lambda a: a < 0)


def any_missing(alleles: Column) -> Column:
    return F.exists(alleles, lambda a: a < 0)


def is_variant(alleles: Column) -> Column:
    return F.exists(alleles, lambda a: a > 0)


def is_hom(alleles: Column) -> Column:
    """All alleles alike, of ploidy two or more."""
    return (F.size(alleles) > 1) & (F.size(F.array_distinct(alleles)) == 1)


def is_het(alleles: Column) -> Column:
    return (F.size(alleles) == 2) & (alleles[0] != alleles[1])


def is_haploid(alleles: Column) -> Column:
    return F.size(alleles) == 1


def is_valid(alleles: Column, alts: Column) -> Column:
    return F.forall(alleles, lambda a: a <= F.size(alts))


def redundant_first_base(ref: Column, alts: Column) -> Column:
    """Whether every ALT but spanning deletions starts with the first base of REF (and there is such an ALT)."""
    plain = F.filter(alts, lambda a: F.substring(a, 1, 1) != "*")
    return (F.size(plain) > 0) & F.forall(plain, lambda a: F.substring(a, 1, 1) == F.substring(ref, 1, 1))


def unpadded(ref: Column, alts: Column) -> Column:
    """REF and ALTs, without the first base where it is redundant."""
    pad = redundant_first_base(ref, alts)
    cut = lambda a: F.when(pad & (F.substring(a, 1, 1) != "*"), a.substr(F.lit(2), F.length(a))).otherwise(a)
    return F.concat(F.array(F.when(pad, ref.substr(F.lit(2), F.length(ref))).otherwise(ref)), F.transform(alts, cut))


def normalise_allele(allele: Column) -> Column:
    """Bases in upper case; names in <> or [] keep theirs."""
    plain = ~allele.rlike(r"[<\[\]]")
    return F.when(plain, F.translate(allele, "acgtn", "ACGTN")).otherwise(allele)


def symbolic_type(allele: Column) -> Column:
    first, last = F.substring(allele, 1, 1), F.substring(allele, -1, 1)
    return (
        F.when((first == "<") | (last == ">"), F.lit("SV_SYMBOLIC"))
        .when((first == "*") | (last == "*"), F.lit("SV_MISSING"))
        .when(first.isin("[", "]") | last.isin("[", "]"), F.lit("SV_BREAKEND"))
    )


def allele_type(ref: Column, alt: Column) -> Column:
    """Type of one allele against the reference, both unpadded."""
    n_ref, n_alt = F.length(ref), F.length(alt)
    short = F.when(n_ref < n_alt, ref).otherwise(alt)
    long = F.when(n_ref < n_alt, alt).otherwise(ref)
    n, m = F.length(short), F.length(long)
    # A pure insertion or deletion: some cut of the shorter allele is a prefix and a suffix of the longer.
    whole = lambda k: (short.substr(F.lit(1), k) == long.substr(F.lit(1), k)) & (short.substr(k + 1, n) == long.substr(m - n + k + 1, n))
    pure = (n == 0) | F.exists(F.sequence(F.lit(0), n), whole)
    return (
        F.when(ref == alt, F.lit("UNCHANGED"))
        .when((n_ref == 1) & (n_alt == 1) & (alt != "*"), F.lit("SNP"))
        .when(symbolic_type(alt).isNotNull(), symbolic_type(alt))
        .when(n_ref == n_alt, F.lit("MNP"))
        .when(pure & (n_ref < n_alt), F.lit("INSERTION"))
        .when(pure, F.lit("DELETION"))
        .otherwise(F.lit("INDEL"))
    )


def precedence(types: Column) -> Column:
    """The type of a set of types: different indel types make INDEL, else the later in TYPES wins."""
    rank = lambda t: F.array_position(F.array(*map(F.lit, TYPES)), t)

    def join(a: Column, b: Column) -> Column:
        mixed = (a != b) & a.isin(*INDEL_TYPES) & b.isin(*INDEL_TYPES)
        return F.when(a.isNull(), b).when(mixed, F.lit("INDEL")).when(rank(a) > rank(b), a).otherwise(b)

    return F.aggregate(types, F.lit(None).cast("string"), join)


def genotype_type(ref: Column, alts: Column, alleles: Column) -> Column:
    """Type of a genotype by its called ALTs; UNCHANGED without any."""
    strings = unpadded(ref, alts)
    called = F.filter(F.array_distinct(alleles), lambda a: a > 0)
    types = F.transform(called, lambda a: allele_type(strings[0], F.get(strings, a)))
    return F.when(F.size(called) == 0, F.lit("UNCHANGED")).otherwise(precedence(types))


def record_end(start: Column, ref: Column, info: Column) -> Column:
    """INFO/END where given, else start and the length of REF."""
    return F.coalesce(F.try_element_at(info, F.lit("END")).cast("int"), start + F.length(ref))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda best, k: F.when(a.substr(F.lit(1), k) == b.substr(F.lit(1), k), F.greatest(best, k)).otherwise(best))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def mnp_span(ref: Column, alt: Column) -> Column:
    """(start, length) of the part in which alleles of equal length differ."""
    left = common_prefix(ref, alt)
    right = F.least(common_suffix(ref, alt), F.length(ref) - left)
    return F.struct(left.alias("start"), (F.length(ref) - left - right).alias("length"))


def trim_mnp(ref: Column, alt: Column) -> Column:
    """(ref, alt) cut to where they differ, if of equal length above one and different."""
    span = mnp_span(ref, alt)
    cut = (F.length(ref) > 1) & (F.length(ref) == F.length(alt)) & (ref != alt)
    part = lambda x: F.when(cut, x.substr(span["start"] + 1, span["length"])).otherwise(x)
    return F.struct(part(ref).alias("ref"), part(alt).alias("alt"))


def breakend(alt: Column) -> Column:
    """Parts of a breakend ALT: ref bases, whether the local part comes first, remote name, 0-based place, whether the remote part is reversed (``]``)."""
    bracket = F.regexp_extract(alt, r"([\[\]])", 1)
    remote = F.regexp_extract(alt, r"[\[\]](.+):([0-9]+)[\[\]]", 1)
    place = F.regexp_extract(alt, r"[\[\]](.+):([0-9]+)[\[\]]", 2).cast("int") - 1
    up = ~F.substring(alt, 1, 1).isin("[", "]")
    bases = F.regexp_replace(alt, r"[\[\]].*[\[\]]", "")
    return F.when(remote != "", F.struct(bases.alias("bases"), up.alias("local_up"), remote.alias("remote_seq"), place.alias("remote_pos"), (bracket == "]").alias("remote_up")))


def format_breakend(bases: Column, local_up: Column, remote_seq: Column, remote_pos: Column, remote_up: Column) -> Column:
    """The inverse of ``breakend``."""
    mark = F.when(remote_up, F.lit("]")).otherwise(F.lit("["))
    middle = F.concat(mark, remote_seq, F.lit(":"), (remote_pos + 1).cast("string"), mark)
    return F.when(local_up, F.concat(bases, middle)).otherwise(F.concat(middle, bases))


def symbolic_parts(alt: Column) -> Column:
    """Names within ``<A:B>``, split at the colons."""
    return F.split(F.regexp_extract(alt, r"<([^>]*)>", 1), ":")


def replay(template: Column, start: Column, end: Column, allele: Column) -> Column:
    """The template with [start, end) replaced by the allele."""
    return F.concat(template.substr(F.lit(1), start), allele, template.substr(end + 1, F.length(template)))


# The standard genetic code, codons in the order TCAG for each base.
_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_frame(seq: Column, frame: int) -> Column:
    """Protein of one of six frames: 1 to 3 forward, -1 to -3 on the reverse complement; X for unknown bases."""
    strand = F.upper(seq) if frame > 0 else F.upper(reverse_complement(seq))
    first = abs(frame) - 1
    n = F.floor((F.length(seq) - first) / 3).cast("int")
    code = F.lit(_AMINO_ACIDS)

    def amino(i: Column) -> Column:
        places = [F.call_function("instr", F.lit("TCAG"), strand.substr(i * 3 + (first + k + 1), F.lit(1))) - 1 for k in range(3)]
        known = (places[0] >= 0) & (places[1] >= 0) & (places[2] >= 0)
        return F.when(known, code.substr(places[0] * 16 + places[1] * 4 + places[2] + 1, F.lit(1))).otherwise(F.lit("X"))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), amino), "")).otherwise(F.lit(""))
