"""Readers and writers of variant, interval, sequence, alignment, pedigree and table texts.

Line formats are read by Spark's text reader and parsed as columns; a header is read on the
driver from the file's first lines alone.  Formats whose records span lines are joined by the
line's place within its file, which Spark's whole-record readers keep together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N


# ------------------------------------------------------------------ headers


@dataclass
class Field:
    id: str
    number: str = "."
    type: str = "String"
    description: str = ""

    def superset(self, other: "Field") -> "Field":
        """The declaration that holds for both, or an error."""
        kinds = {self.type, other.type}
        if self.number != other.number and "." not in (self.number, other.number):
            raise ValueError(f"{self.id}: numbers {self.number} and {other.number} don't go together")
        if len(kinds) > 1 and kinds != {"Integer", "Float"}:
            raise ValueError(f"{self.id}: types {self.type} and {other.type} don't go together")
        return Field(self.id, "." if self.number != other.number else self.number, "Float" if len(kinds) > 1 else self.type, self.description or other.description)


@dataclass
class Header:
    """Declarations of a variant file, in order."""

    info: dict[str, Field] = field(default_factory=dict)
    format: dict[str, Field] = field(default_factory=dict)
    filter: dict[str, Field] = field(default_factory=dict)
    alt: dict[str, Field] = field(default_factory=dict)
    contigs: dict[str, int | None] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    def merge(self, other: "Header", force: bool = False) -> "Header":
        """Union of two headers; declarations of one id must go together unless forced."""
        out = Header(contigs=self.contigs | other.contigs, samples=[*self.samples, *(s for s in other.samples if s not in self.samples)], other=[*self.other, *(x for x in other.other if x not in self.other)])
        for kind in ("info", "format", "filter", "alt"):
            mine, theirs, merged = getattr(self, kind), getattr(other, kind), getattr(out, kind)
            for key, value in (mine | theirs).items():
                try:
                    merged[key] = mine[key].superset(theirs[key]) if key in mine and key in theirs else value
                except ValueError:
                    if not force:
                        raise
                    merged[key] = mine[key]
        return out

    def allele_dependent(self, kind: str) -> list[str]:
        """Fields whose number is per allele or genotype."""
        return [k for k, f in getattr(self, kind).items() if f.number in ("A", "R", "G")]

    def lines(self) -> list[str]:
        out = ["##fileformat=VCFv4.2"]
        out += [f"##contig=<ID={c}" + (f",length={n}>" if n is not None else ">") for c, n in self.contigs.items()]
        out += [f'##FILTER=<ID={f.id},Description="{f.description}">' for f in self.filter.values()]
        out += [f'##ALT=<ID={f.id},Description="{f.description}">' for f in self.alt.values()]
        for kind in ("info", "format"):
            out += [f'##{kind.upper()}=<ID={f.id},Number={f.number},Type={f.type},Description="{f.description}">' for f in getattr(self, kind).values()]
        columns = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *self.samples] if self.samples else [])
        return out + self.other + ["#" + "\t".join(columns)]


def parse_header(lines: list[str]) -> Header:
    if not lines or not lines[0].startswith("##fileformat=VCF"):
        raise ValueError("no fileformat line")
    out = Header()
    for line in lines[1:]:
        m = re.match(r"##(INFO|FORMAT|FILTER|ALT|contig)=<(.*)>\s*$", line)
        if m:
            parts = dict((k, v.strip('"')) for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2]))
            if m[1] == "contig":
                out.contigs[parts["ID"]] = int(parts["length"]) if "length" in parts else None
            else:
                getattr(out, m[1].lower())[parts["ID"]] = Field(parts["ID"], parts.get("Number", "."), parts.get("Type", "String"), parts.get("Description", ""))
        elif line.startswith("#CHROM"):
            out.samples = line.split("\t")[9:]
        else:
            out.other.append(line)
    return out


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a file (or of the first of several): its lines that start with #, read up to the column line."""
    first = spark.read.text(path).where(F.col("value").startswith("#")).take(100_000)
    lines = [r["value"] for r in first]
    stop = next((i for i, x in enumerate(lines) if x.startswith("#CHROM")), len(lines) - 1)
    return parse_header(lines[: stop + 1])


# ------------------------------------------------------------------ variants


def parse_vcf(lines: DataFrame, header: Header, samples: list[str] | None = None) -> DataFrame:
    """Records of text lines (column ``value``); only the ``samples`` asked for are parsed.

    A line with too few or blank fields, a bad place, or an empty REF or ALT is an error.
    """
    c = F.split("value", "\t")
    bad = (F.size(c) < 8) | F.exists(F.slice(c, 1, 8), lambda x: x == "") | ~c[1].rlike("^[0-9]+$") | (F.size(c) != 9 + len(header.samples) if header.samples else F.size(c) > 9)
    checked = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.when(bad, F.raise_error(F.concat(F.lit("not a record: "), "value"))).otherwise(c).alias("c"))
    dot = lambda x: F.when(x != ".", x)
    many = lambda x, by: F.when(x == ".", F.array().cast("array<string>")).otherwise(F.split(x, by))
    col = lambda i: F.col("c")[i]
    entries = F.transform(many(col(7), ";"), lambda e: F.struct(F.substring_index(e, "=", 1).alias("key"), F.when(F.contains(e, F.lit("=")), F.regexp_replace(e, "^[^=]*=", "")).otherwise(F.lit("")).alias("value")))
    keys = F.split(F.get(F.col("c"), F.lit(8)), ":")
    wanted = [(i, s) for i, s in enumerate(header.samples) if samples is None or s in samples]

    def sample(i: int, name: str) -> Column:
        values = F.split(F.get(F.col("c"), F.lit(9 + i)), ":")
        padded = F.transform(keys, lambda _, k: F.coalesce(F.get(values, k), F.lit(".")))
        return F.struct(F.lit(name).alias("sample"), F.map_from_arrays(keys, padded).alias("fields"))

    return checked.select(
        col(0).alias("seq"), (col(1).cast("int") - 1).alias("start"), many(col(2), ";").alias("id"), col(3).alias("ref"), many(col(4), ",").alias("alts"), dot(col(5)).try_cast("double").alias("qual"),
        many(col(6), ";").alias("filters"), F.transform(entries, lambda e: e["key"]).alias("info_keys"), F.map_from_entries(entries).alias("info"), F.coalesce(keys, F.array().cast("array<string>")).alias("format"),
        (F.array(*(sample(i, s) for i, s in wanted)) if wanted else F.array().cast("array<struct<sample:string,fields:map<string,string>>>")).alias("samples"),
    ).withColumn("end", F.coalesce(F.try_element_at("info", F.lit("END")).try_cast("int"), F.col("start") + F.length("ref")))


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> tuple[Header, DataFrame]:
    header = read_header(spark, path)
    return header, parse_vcf(spark.read.text(path), header, samples)


def format_vcf(df: DataFrame) -> DataFrame:
    """Records as text lines (``value``); trailing missing sub-fields of a sample are left out."""
    dot = lambda x: F.when(x.isNull() | (x == ""), F.lit(".")).otherwise(x)
    info = F.array_join(F.transform("info_keys", lambda k: F.when(F.try_element_at("info", k) == "", k).otherwise(F.concat(k, F.lit("="), F.try_element_at("info", k)))), ";")
    fields = lambda s: F.regexp_replace(F.array_join(F.transform("format", lambda k: F.coalesce(F.try_element_at(s["fields"], k), F.lit("."))), ":"), r"(:\.)+$", "")
    qual = F.when(F.col("qual").isNull(), ".").otherwise(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""))
    parts = F.array("seq", (F.col("start") + 1).cast("string"), dot(F.array_join("id", ";")), "ref", dot(F.array_join("alts", ",")), qual, dot(F.array_join("filters", ";")), dot(info))
    tail = F.when(F.size("samples") > 0, F.concat(F.array(F.array_join("format", ":")), F.transform("samples", fields))).otherwise(F.array().cast("array<string>"))
    return df.select("seq", "start", F.array_join(F.concat(parts, tail), "\t").alias("value"))


def write_vcf(df: DataFrame, header: Header, path: str) -> None:
    """Ordered text parts: the header in the first, then records by contig and place."""
    rank = F.create_map(*(x for i, c in enumerate(header.contigs) for x in (F.lit(c), F.lit(i)))) if header.contigs else None
    order = F.coalesce(F.try_element_at(rank, F.col("seq")), F.lit(len(header.contigs))) if rank is not None else F.lit(0)
    spark = df.sparkSession
    body = format_vcf(df).select(order.alias("rank_"), "seq", "start", "value")
    head = spark.createDataFrame([(-1, "", i, line) for i, line in enumerate(header.lines())], "rank_ int, seq string, start int, value string")
    head.unionByName(body).repartitionByRange("rank_", "seq", "start").sortWithinPartitions("rank_", "seq", "start", "value").select("value").write.mode("overwrite").text(path)


# ------------------------------------------------------------------ intervals and tables


def read_bed(spark: SparkSession, path: str, least_fields: int = 0, widen_empty: bool = False) -> DataFrame:
    """seq, start, end, fields; header lines are left out, and empty intervals can be widened to one base."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    c = F.split("value", "\t")
    df = lines.select(c[0].alias("seq"), c[1].cast("int").alias("start"), c[2].cast("int").alias("end"), F.slice(c, 4, F.greatest(F.size(c) - 3, F.lit(1))).alias("fields"))
    df = df.withColumn("fields", F.filter("fields", lambda f: f.isNotNull()))
    if least_fields:
        df = df.where(F.when(F.size("fields") < least_fields, F.raise_error(F.lit("too few fields in an interval"))).otherwise(True))
    return df.withColumn("end", F.when(F.col("end") == F.col("start"), F.col("end") + 1).otherwise(F.col("end"))) if widen_empty else df


def write_bed(df: DataFrame, path: str) -> None:
    rest = [F.array_join("fields", "\t")] if "fields" in df.columns else []
    line = F.concat_ws("\t", "seq", "start", "end", *(F.when(r != "", r) for r in rest))
    df.repartitionByRange("seq", "start").sortWithinPartitions("seq", "start", "end").select(line.alias("value")).write.mode("overwrite").text(path)


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """(name, start, end), half-open and 0-based, of ``name``, ``name:s``, ``name:s-e``, ``name:s+len`` or ``name:p~pad``."""
    m = re.fullmatch(r"(.+):([\d,]+)(?:([-+~])([\d,]+))?", text)
    if not m:
        return text, None, None
    name, a, kind, b = m[1], int(m[2].replace(",", "")), m[3], m[4] and int(m[4].replace(",", ""))
    if a < 1:
        raise ValueError(f"places start at 1: {text}")
    if kind is None:
        return name, a - 1, None
    if kind == "-":
        if b < a:
            raise ValueError(f"a region ends before it starts: {text}")
        return name, a - 1, b
    return (name, a - 1, a - 1 + b) if kind == "+" else (name, max(0, a - 1 - b), a - 1 + b)


def region_filter(text: str) -> Column:
    """Rows that overlap a region text; a literal predicate, so it reaches the scan of a sorted store."""
    name, start, end = parse_region(text)
    out = F.col("seq") == name
    if start is not None:
        out = out & (F.col("end") > start)
    return out & (F.col("start") < end) if end is not None else out


def write_indexed(df: DataFrame, path: str) -> None:
    """The store that takes the place of an indexed text: Parquet by sequence, sorted by place."""
    df.repartitionByRange("seq", "start").sortWithinPartitions("seq", "start").write.mode("overwrite").partitionBy("seq").parquet(path)


def read_ped(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Individuals (id, family, sex, affected, primary_) and relationships (first, second, type)."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.when(F.size(c) == 6, c).otherwise(F.raise_error(F.concat(F.lit("not six columns: "), "value"))).alias("c"))
    x = lambda i: F.col("c")[i]
    sex = F.when(x(4) == "1", "male").when(x(4) == "2", "female").otherwise("unknown")
    people = rows.select(x(1).alias("id"), x(0).alias("family"), sex.alias("sex"), F.when(x(5) == "2", True).when(x(5) == "1", False).alias("affected"), F.lit(True).alias("primary_"))
    links = rows.select(x(1).alias("second"), F.explode(F.filter(F.array(x(2), x(3)), lambda p: p != "0")).alias("first"))
    return people, links.select("first", "second", F.lit("PARENT_CHILD").alias("type"))


def format_ped(people: DataFrame, fams: DataFrame) -> DataFrame:
    """Six-column lines (``value``) of individuals and their families (child, father, mother)."""
    met = people.join(fams, people["id"] == fams["child"], "left")
    sex = F.when(F.col("sex") == "male", "1").when(F.col("sex") == "female", "2").otherwise("0")
    affected = F.when(F.col("affected"), "2").when(~F.col("affected"), "1").otherwise("0")
    return met.select(F.concat_ws("\t", "family", "id", F.coalesce("father", F.lit("0")), F.coalesce("mother", F.lit("0")), sex, affected).alias("value"))


def header_pedigree(header: Header) -> tuple[list[dict], list[dict]]:
    """Individuals and relationships of a variant header's SAMPLE and PEDIGREE lines."""
    people, links = {s: {"id": s, "sex": "unknown"} for s in header.samples}, []
    for line in header.other:
        m = re.match(r"##(SAMPLE|PEDIGREE)=<(.*)>", line)
        if not m:
            continue
        parts = dict(re.findall(r"(\w+)=([^,]*)", m[2]))
        if m[1] == "SAMPLE":
            person = people.setdefault(parts["ID"], {"id": parts["ID"], "sex": "unknown"})
            person["sex"] = {"MALE": "male", "FEMALE": "female"}.get(parts.get("Sex", "").upper(), "unknown")
        elif "Child" in parts:
            links += [{"first": parts[k], "second": parts["Child"], "type": "PARENT_CHILD"} for k in ("Father", "Mother") if k in parts]
        elif "Derived" in parts:
            links.append({"first": parts["Original"], "second": parts["Derived"], "type": "ORIGINAL_DERIVED"})
    return list(people.values()), links


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """id, parent, rank, name of a versioned four-column table."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(c[0].cast("int").alias("id"), c[1].cast("int").alias("parent"), c[2].alias("rank"), c[3].alias("name"))


def read_roc(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Preamble values and points of a curve table; columns follow its own header line."""
    head = [r["value"] for r in spark.read.text(path).where(F.col("value").startswith("#")).take(1000)]
    values = {k.strip(): v.strip() for k, _, v in (x.lstrip("#").partition(":") for x in head) if v}
    names = [re.sub(r"\W+", "_", n.strip()) for n in head[-1].lstrip("#").split("\t")]
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return values, rows.select(*(c[i].try_cast("double").alias(n) for i, n in enumerate(names)))


def read_name_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Pairs of names of a small two-column file."""
    return dict(r["value"].split()[:2] for r in spark.read.text(path).where("value != ''").toLocalIterator())


def read_reference_config(lines: list[str]) -> list[dict]:
    """Ploidy rows (sex, seq, start, end, ploidy) of a reference description.

    Lines: ``sex seq NAME SHAPE`` with ploidy by ``def``; ``dup`` lines (duplicated regions)
    make the second region ploidy 0 and the first diploid for that sex.
    """
    ploidy = {"diploid": 2, "haploid": 1, "none": 0, "polyploid": -1}
    out = []
    for line in lines:
        x = line.split("#")[0].split()
        if len(x) >= 4 and x[1] == "seq":
            out.append({"sex": x[0], "seq": x[2], "start": 0, "end": 2**31 - 1, "ploidy": ploidy[x[3]]})
        elif len(x) >= 4 and x[1] == "dup":
            for text, n in ((x[2], 2), (x[3], 0)):
                name, start, end = parse_region(text)
                out.append({"sex": x[0], "seq": name, "start": start, "end": end, "ploidy": n})
    return out


# ------------------------------------------------------------------ sequences and alignments


def read_fasta(spark: SparkSession, path: str, mask_lower: bool = False) -> DataFrame:
    """name, description, residues.  Records end at the next >, so each is one row of the reader."""
    text = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, instr(value, '\\n') + 1)"), r"\s", "")
    body = F.regexp_replace(body, "[a-z]", "N") if mask_lower else body
    return text.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*(.*)", 1)).alias("description"), body.alias("residues"))


def format_fasta(df: DataFrame, width: int = 80) -> DataFrame:
    body = F.rtrim(F.regexp_replace("residues", f"(.{{{width}}})", "$1\n")) if width else F.col("residues")
    return df.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(body, "\n$", "")).alias("value"))


def decode_quality(text: Column, encoding: str = "sanger") -> Column:
    """Phred values of quality text: sanger (from !), illumina (from @), or solexa odds."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.transform(codes, lambda c: {"sanger": lambda: c - 33, "illumina": lambda: c - 64, "solexa": lambda: N.solexa_to_phred(c)}[encoding]())


def read_fastq(spark: SparkSession, path: str, encoding: str = "sanger") -> DataFrame:
    """name, residues, quals.  Files (or blocks, as splittable stores hold them) are read whole and cut into four-line records."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"@([^\n]*)\n([^\n]*)\n\+[^\n]*\n([^\n]*)"), F.lit(0))).alias("r"))
    part = lambda i: F.split("r", "\n")[i]
    return files.select(F.regexp_extract(part(0), r"^@(\S*)", 1).alias("name"), part(1).alias("residues"), decode_quality(part(3), encoding).alias("quals"))


def format_fastq(df: DataFrame, default_quality: int = 20) -> DataFrame:
    quals = F.coalesce(F.array_join(F.transform("quals", lambda q: F.char(q + 33)), ""), F.repeat(F.lit(chr(33 + default_quality)), F.length("residues")))
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "residues", F.lit("+"), quals).alias("value"))


def read_sam(spark: SparkSession, path: str, skip_invalid: bool = True) -> DataFrame:
    """name, flag, seq, pos (0-based, -1 unplaced), mapq, cigar, residues, quality, length, tags, nh, as_score, read_group."""
    c = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    valid = (F.size(c) >= 11) & c[1].rlike("^[0-9]+$") & c[3].rlike("^[0-9]+$")
    lines = lines.where(valid) if skip_invalid else lines.where(F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("not an alignment: "), "value"))))
    tags = F.map_from_entries(F.transform(F.filter(c, lambda _, i: i > 10), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_replace(t, "^..:.:", ""))))
    df = lines.select(c[0].alias("name"), c[1].cast("int").alias("flag"), c[2].alias("seq"), (c[3].cast("int") - 1).alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[9].alias("residues"), c[10].alias("quality"), tags.alias("tags"))
    number = lambda k: F.try_element_at("tags", F.lit(k)).try_cast("int")
    return df.withColumns({"length": F.length("residues"), "nh": number("NH"), "as_score": number("AS"), "read_group": F.try_element_at("tags", F.lit("RG"))})


def sam_to_reads(df: DataFrame) -> DataFrame:
    """Reads of alignments: primary ones, in the direction of the machine, one per name and arm."""
    from ..functions.alleles import reverse_complement

    primary = df.where(F.col("flag").bitwiseAND(0x900) == 0)
    back = F.col("flag").bitwiseAND(16) != 0
    arm = F.when(F.col("flag").bitwiseAND(1) == 0, "single").when(F.col("flag").bitwiseAND(64) != 0, "left").otherwise("right")
    quals = decode_quality(F.when(F.col("quality") != "*", F.col("quality")))
    return primary.select("name", arm.alias("arm"), F.when(back, reverse_complement(F.col("residues"))).otherwise(F.col("residues")).alias("residues"), F.when(back, F.reverse(quals)).otherwise(quals).alias("quals"), "read_group").dropDuplicates(["name", "arm"])


def format_sam(df: DataFrame) -> DataFrame:
    """Unaligned alignment lines of reads (name, arm, residues, quals)."""
    flag = F.when(F.col("arm") == "left", 77).when(F.col("arm") == "right", 141).otherwise(4)
    quals = F.coalesce(F.array_join(F.transform("quals", lambda q: F.char(q + 33)), ""), F.lit("*"))
    return df.select(F.concat_ws("\t", "name", flag.cast("string"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), "residues", quals).alias("value"))


def write_sequence_set(df: DataFrame, path: str) -> None:
    """Sequences as Parquet (seq_id, name, residues, quals, arm), the columnar store of sets."""
    df.repartitionByRange("seq_id").sortWithinPartitions("seq_id").write.mode("overwrite").parquet(path)


def template_tiles(sequences: DataFrame, tile: int = 10_000) -> DataFrame:
    """(seq, tile, bases): a reference cut into tiles, for joins by place."""
    n = F.floor((F.length("residues") + tile - 1) / tile).cast("int")
    each = sequences.where(F.length("residues") > 0).withColumn("tile", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.select(F.col("name").alias("seq"), F.col("tile").cast("long").alias("tile"), F.col("residues").substr(F.col("tile") * tile + 1, F.lit(tile)).alias("bases"))


def read_sequence_set(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A sequence set, or the ids [start, end) of it; the range reaches the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("seq_id") >= start) if start is not None else df
    return df.where(F.col("seq_id") < end) if end is not None else df


def read_reads_table(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a tab-separated table: name, residues, and qualities if there is a third column; # starts a comment."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|>|\s*$)"))
    return rows.select(c[0].alias("name"), c[1].alias("residues"), F.when(F.size(c) > 2, decode_quality(F.get(c, F.lit(2)))).alias("quals"))


def read_distribution(lines: list[str]) -> dict[str, float]:
    """Weights by name of a two-column text; they are made to add up to one."""
    pairs = [(x.split()[1], float(x.split()[0])) for x in lines if x.strip() and not x.startswith("#")]
    total = sum(w for _, w in pairs)
    return {name: w / total for name, w in pairs}


def read_genetic_map(lines: list[str]) -> list[tuple[int, float]]:
    """(place, centimorgans) of a table whose first line names its columns."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    return [(int(r[0]), float(r[-1])) for r in rows if r[0].isdigit()]


def read_properties(lines: list[str]) -> dict[str, str]:
    """Names and values of a properties text."""
    pairs = (re.split(r"\s*[=:]\s*", x.strip(), maxsplit=1) for x in lines if x.strip() and x.strip()[0] not in "#!")
    return {p[0]: p[1] if len(p) > 1 else "" for p in pairs}


def taxon_sequences(sequences: DataFrame, names_to_taxa: DataFrame, nodes: DataFrame, taxon: int) -> DataFrame:
    """Sequences of a taxon or any under it; ``names_to_taxa``: (name, id)."""
    from ..operators.pedigree import subtree

    wanted = names_to_taxa.join(subtree(nodes, [taxon]).select("id"), "id", "left_semi").select("name").distinct()
    return sequences.join(wanted, "name", "left_semi")
