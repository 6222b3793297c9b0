"""Sequence algebra: masks, context sites, variants, columns of an alignment, truncation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import bases as B


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def terminal_repeat(seq: Column, max_bp: int = 20_000, min_bp: int = 1000) -> Column:
    """The longest head of ``min_bp`` or more that is the reverse complement of the tail, by
    bisection: if a head matches, so does every shorter one. 0 if none does. Case is ignored."""
    seq = F.upper(seq)
    n = F.least(F.lit(max_bp), F.floor(F.length(seq) / 2).cast("int"))
    ends = F.struct(F.left(seq, n).alias("head"), F.left(reverse_complement(seq), n).alias("tail"), n.alias("n"))
    steps = F.sequence(F.lit(1), F.lit(max(1, max_bp).bit_length() + 1))

    def longest(x: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
            ok = F.left(x["head"], mid) == F.left(x["tail"], mid)
            return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(ok, mid).otherwise(s["low"]).alias("low"), F.when(ok, s["high"]).otherwise(mid - 1).alias("high")))

        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), x["n"].alias("high")), halve, lambda s: s["low"])

    # as the element of an array, both ends are cut once, not at every step
    found = F.get(F.transform(F.array(ends), longest), F.lit(0))
    return F.when(found >= min_bp, found).otherwise(0)


def masked(seq: Column, intervals: list[tuple[int, int]]) -> Column:
    """Half-open intervals as N; they may overlap and reach beyond the ends."""
    n = F.length(seq)
    for s, e in intervals:
        s = max(0, s)
        width = F.least(F.lit(e), n) - s
        seq = F.when(width > 0, F.overlay(seq, F.repeat(F.lit("N"), width), F.lit(s + 1), width)).otherwise(seq)
    return seq


def mask_columns(seq: Column, columns: list[int]) -> Column:
    """0-based columns as N."""
    return masked(seq, [(c, c + 1) for c in columns])


def union_intervals(intervals: DataFrame, *keys: str) -> DataFrame:
    """``start, end`` (and ``keys``: a reference) of intervals that neither overlap nor touch
    and cover what the given half-open ones do. Empty and null ones are left out, starts
    below 0 are 0, a null key is a key. Sorted by start, an interval opens a new run where
    no earlier one reaches it; of equal starts only the farthest end is sorted, so a
    reference has as many rows there as places at most, however many intervals."""
    start = F.greatest(F.lit(0), F.col("start"))
    far = intervals.select(*keys, start.alias("start"), "end").where("end > start").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    before = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    runs = far.withColumn("__opens", opens.cast("int")).withColumn("__run", F.sum("__opens").over(upto))
    return runs.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def mask_intervals(genomes: DataFrame, intervals: DataFrame, key: str | None = None, seq: str = "seq") -> DataFrame:
    """``genomes`` with the half-open ``intervals`` (``start, end``, a table as ``read_bed``
    gives it; they may overlap and reach beyond the ends) of ``seq`` as N: all of them, or
    those of the genome's ``key``. Each genome's disjoint intervals are one sorted array,
    over which a fold goes once. Genomes without intervals stay as they are."""
    keys = [key] if key else []
    told = union_intervals(intervals, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__mask"))  # at most half as many as a reference has places
    if key:
        both = genomes.join(told, key, "left")
    else:
        both = genomes.join(F.broadcast(told))  # one row
    n, s = F.length(seq), F.col(seq)
    cut = F.transform("__mask", lambda x: F.struct(F.least(x["start"], n).alias("start"), F.least(x["end"], n).alias("end")))
    both = both.withColumn("__mask", cut)

    def piece(x: Column, i: Column) -> Column:
        done = F.when(i > 0, F.get("__mask", i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(s, done + 1, x["start"] - done), F.repeat(F.lit("N"), x["end"] - x["start"]))

    tail = F.substring(s, F.element_at("__mask", -1)["end"] + 1, n)
    told = F.when(F.size("__mask") > 0, F.concat(F.array_join(F.transform("__mask", piece), ""), tail)).otherwise(s)
    return both.withColumn(seq, told).select(*genomes.columns)


def mask_column_table(genomes: DataFrame, columns: DataFrame, seq: str = "seq") -> DataFrame:
    """``genomes`` with the 0-based columns of a table (``column``) as N."""
    at = F.col("column").cast("int")
    return mask_intervals(genomes, columns.select(at.alias("start"), (at + 1).alias("end")), seq=seq)


def positions(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``pos`` (from 1), ``base``: a row a position of ``seq``."""
    return df.select(*keep, F.posexplode(bases(F.col("seq"))).alias("pos", "base")).withColumn("pos", F.col("pos") + 1)


def bases(seq: Column) -> Column:
    """A sequence as an array, so that a base is found without counting characters."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def _around(ref: Column, i: Column) -> tuple[Column, Column]:
    """The bases before and after place ``i`` (from 0) of an array; null beyond its ends."""
    return F.when(i > 0, F.get(ref, i - 1)), F.get(ref, i + 1)


def eligible_sites(reference: DataFrame) -> DataFrame:
    """``pos, context``: C after T (TC), G before A (GA)."""
    ref = reference.select(bases(F.col("seq")).alias("ref"))

    def site(b: Column, i: Column) -> Column:
        before, after = _around(F.col("ref"), i)
        return F.struct((i + 1).alias("pos"), F.when((b == "C") & (before == "T"), "TC").when((b == "G") & (after == "A"), "GA").alias("context"))

    found = F.filter(F.transform("ref", site), lambda x: x["context"].isNotNull())
    return ref.select(F.explode(found).alias("x")).select("x.pos", "x.context")


def site_totals(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count("*").alias("l_total"), F.count_if(F.col("context") == "TC").alias("l_tc"), F.count_if(F.col("context") == "GA").alias("l_ga"))


def _sequence(reference: DataFrame) -> B.Reference:
    """The one sequence to compare with: a genome, whatever the size of the cohort. A
    second row is an error, none (or null) an empty sequence."""
    rows = reference.select("seq").limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one reference")
    return B.Reference((rows[0].seq if rows else None) or "")


def variants(genomes: DataFrame, reference: DataFrame, same_length: bool = True) -> DataFrame:
    """``accession, pos, ref, alt, context``: the places where a genome and the reference
    have different known bases, case ignored; the context is the reference's. ``reference``:
    one row, ``seq``. Genomes of another length are skipped, or compared as far as both go.
    Genomes are compared as bytes in their tasks; only differences become rows."""
    kind = genomes.select("accession").dtypes[0][1]
    task = partial(B.list_differences, ref=_sequence(reference), same_length=same_length)
    return genomes.select("accession", F.col("seq").cast("string")).mapInArrow(task, f"accession {kind}, pos int, ref string, alt string, context string")


def count_variants(genomes: DataFrame, reference: DataFrame, same_length: bool = True) -> DataFrame:
    """``variant_counts`` of every genome in one pass: no row a difference, no shuffle.
    Genomes of another length are left out if ``same_length``; null ones always."""
    kind = genomes.select("accession").dtypes[0][1]
    task = partial(B.count_differences, ref=_sequence(reference), same_length=same_length)
    out = genomes.select("accession", F.col("seq").cast("string")).mapInArrow(task, f"accession {kind}, total_snvs long, apobec3_snvs long")
    out = out.withColumn("non_apobec3_snvs", F.col("total_snvs") - F.col("apobec3_snvs"))
    return out.withColumn("apobec3_fraction", F.when(F.col("total_snvs") > 0, F.col("apobec3_snvs") / F.col("total_snvs")).otherwise(0.0))


def branch_counts(genomes: DataFrame, ancestor: DataFrame, clade: str = "Ib") -> tuple[DataFrame, DataFrame]:
    """Of the genomes of a clade (``accession, clade, seq``): their counts against the
    ancestral sequence (one row, ``seq``), and a row ``n_tips, n_skipped``: those of another
    length are skipped."""
    tips = genomes.where(F.col("clade") == clade)
    length = F.broadcast(ancestor.select(F.length("seq").alias("n")))  # one row
    state = tips.join(length).agg(F.count("*").alias("n_tips"), F.count_if(F.length("seq") != F.col("n")).alias("n_skipped"))
    return count_variants(tips, ancestor), state


def masked_bp(intervals: DataFrame) -> DataFrame:
    """``intervals, bp``: how many and their lengths' sum; overlaps count twice."""
    return intervals.agg(F.count("*").alias("intervals"), F.sum(F.col("end") - F.col("start")).alias("bp"))


def annotate(found: DataFrame, reference: DataFrame, genes: DataFrame) -> DataFrame:
    """Variants with the three bases of the reference around each (N beyond the ends) and the
    gene it is in (``gene, start, end``, half-open, from 0; the first by start, then name;
    null outside). Genes are joined by bins of 1024 bases, not by a range of all."""
    ref = F.broadcast(reference.select(F.concat(F.lit("N"), F.upper("seq"), F.lit("N")).alias("padded")))  # one row
    out = found.join(ref).withColumn("trinucleotide", F.col("padded").substr(F.col("pos"), F.lit(3))).drop("padded")
    binned = genes.select("gene", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 1024), F.floor((F.col("end") - 1) / 1024))).alias("bin"))
    hit = out.select("accession", "pos", F.floor((F.col("pos") - 1) / 1024).alias("bin")).distinct().join(binned, "bin").where("pos - 1 >= start AND pos - 1 < end")
    hit = hit.groupBy("accession", "pos").agg(F.min(F.struct("start", "gene"))["gene"].alias("gene"))
    return out.join(hit, ["accession", "pos"], "left")


#: The standard genetic code, codons in the order of their bases T, C, A, G (a fixed value).
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def amino_acid(codon: Column) -> Column:
    """The letter of a codon, ``*`` for a stop; null unless it is three known bases."""
    at = [F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substring(F.lit(GENETIC_CODE), (16 * at[0] + 4 * at[1] + at[2] + 1).cast("int"), F.lit(1)))


def codon_effects(found: DataFrame, reference: DataFrame, exons: DataFrame) -> DataFrame:
    """``accession, pos, ref, alt, gene, codon`` (its number from 1), ``ref_aa, alt_aa, effect``
    of variants (of ``variants``) within coding exons ``gene, strand, start, end`` (half-open,
    from 0), each by itself against the reference.

    Exons of a gene are spliced in the order of its strand; on ``-`` bases are complements.
    ``effect`` is ``synonymous``, ``missense``, ``stop_gained`` or ``stop_lost``; null where the
    codon is cut short or has an unknown base. A variant in two genes has two rows, one in
    none has no row. Exons are joined by bins of 1024 bases."""
    ref = F.broadcast(reference.select(F.upper("seq").alias("seq")))  # one row
    back = F.col("strand") == "-"
    earlier = W.partitionBy("gene").orderBy(F.when(back, -F.col("start")).otherwise(F.col("start"))).rowsBetween(W.unboundedPreceding, -1)  # exons of one gene
    placed = exons.join(ref).withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(earlier), F.lit(0)))
    part = F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start"))
    placed = placed.withColumn("part", F.when(back, reverse_complement(part)).otherwise(part)).drop("seq")
    spliced = placed.groupBy("gene").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"]), "").alias("coding"))
    binned = placed.join(spliced, "gene").select("gene", "strand", "start", "end", "offset", "coding", F.explode(F.sequence(F.floor(F.col("start") / 1024), F.floor((F.col("end") - 1) / 1024))).alias("bin"))
    hit = found.select("accession", "pos", "ref", "alt", F.floor((F.col("pos") - 1) / 1024).alias("bin")).join(binned, "bin").where("pos - 1 >= start AND pos - 1 < end")
    place = F.col("offset") + F.when(back, F.col("end") - F.col("pos")).otherwise(F.col("pos") - 1 - F.col("start"))
    hit = hit.withColumn("place", place).withColumn("was", F.substring("coding", (F.floor(F.col("place") / 3) * 3 + 1).cast("int"), F.lit(3)))
    alt = F.when(back, F.translate("alt", "ACGT", "TGCA")).otherwise(F.col("alt"))
    hit = hit.withColumn("now", F.overlay("was", alt, (F.col("place") % 3 + 1).cast("int"), 1)).withColumns({"ref_aa": amino_acid(F.col("was")), "alt_aa": amino_acid(F.col("now"))})
    effect = F.when(F.col("ref_aa") == F.col("alt_aa"), "synonymous").when(F.col("alt_aa") == "*", "stop_gained").when(F.col("ref_aa") == "*", "stop_lost").when(F.col("ref_aa").isNotNull() & F.col("alt_aa").isNotNull(), "missense")
    return hit.select("accession", "pos", "ref", "alt", "gene", (F.floor(F.col("place") / 3) + 1).cast("int").alias("codon"), "ref_aa", "alt_aa", effect.alias("effect"))


def variant_counts(genomes: DataFrame, found: DataFrame) -> DataFrame:
    """A row a genome: all variants, those in context, the rest, the fraction in context."""
    agg = found.groupBy("accession").agg(F.count("*").alias("total_snvs"), F.count("context").alias("apobec3_snvs"))
    out = genomes.select("accession").join(agg, "accession", "left").fillna(0, ["total_snvs", "apobec3_snvs"])
    out = out.withColumn("non_apobec3_snvs", F.col("total_snvs") - F.col("apobec3_snvs"))
    return out.withColumn("apobec3_fraction", F.when(F.col("total_snvs") > 0, F.col("apobec3_snvs") / F.col("total_snvs")).otherwise(0.0))


def occupancy(found: DataFrame) -> DataFrame:
    return found.where("context IS NOT NULL").groupBy("pos", "context").agg(F.count("*").alias("occupancy"))


def column_counts(genomes: DataFrame, group: str | None = None) -> DataFrame:
    """``grp, pos, a, c, g, t, missing, other``: how many sequences (``seq``) of each group
    have each base (upper case), N or a gap, or another character in each column (from 1).

    A task counts a block of columns as a matrix; matrices are added a block as they stream
    by, so the network carries a block once a task, not a row a base. ``group``: a string
    column, nulls are a group; without one ``grp`` is null. Null sequences have no column."""
    grp = F.col(group).cast("string") if group else F.lit(None).cast("string")
    counted = genomes.select(grp.alias("grp"), F.col("seq").cast("string").alias("seq")).mapInArrow(B.count_columns, "grp string, block long, counts binary")
    dealt = counted.repartition("grp", "block").sortWithinPartitions("grp", "block")
    return dealt.mapInArrow(B.add_columns, "grp string, pos int, a long, c long, g long, t long, missing long, other long")


def column_statistics(counts: DataFrame) -> DataFrame:
    """A row a column of an alignment (of ``column_counts``): distinct A/C/G/T, share of N
    and gaps, whether it varies, whether it is ambiguous (a tenth or more)."""
    n_bases = sum((F.col(b) > 0).cast("int") for b in "acgt")
    missing = F.col("missing") / (F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("missing") + F.col("other"))
    out = counts.select("pos", n_bases.alias("n_bases"), missing.alias("missing"))
    return out.withColumns({"variable": F.col("n_bases") >= 2, "ambiguous": F.col("missing") >= 0.1})


def homoplasy_columns(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Context sites at which some sequence has the edited base, from ``column_counts``."""
    sites = F.broadcast(eligible_sites(reference))  # of one sequence
    edited = F.when(F.col("context") == "TC", F.col("t")).otherwise(F.col("a"))
    return counts.join(sites, "pos").select("pos", "context", edited.alias("n_sequences")).where("n_sequences > 0")


def truncate_central(seq: Column, retain: float) -> Column:
    """The middle ``retain`` of a sequence, the rest as gaps; lengths round half to even."""
    n = F.length(seq)
    keep = F.bround(n * F.lit(float(retain)), 0).cast("int")
    start = F.floor((n - keep) / 2).cast("int")
    return F.concat(F.repeat(F.lit("-"), start), F.substring(seq, start + 1, keep), F.repeat(F.lit("-"), n - keep - start))


LADDER = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1)


def truncation_ladder(df: DataFrame, levels: tuple[float, ...] = LADDER) -> DataFrame:
    """A row a sequence and level: what is left of it."""
    n = F.length("seq")
    keep = F.bround(n * F.col("retain_frac"), 0).cast("int")
    start = F.floor((n - keep) / 2).cast("int")
    out = df.withColumn("retain_frac", F.explode(F.array(*[F.lit(x) for x in levels])))
    return out.withColumn("seq", F.concat(F.repeat(F.lit("-"), start), F.substring("seq", start + 1, keep), F.repeat(F.lit("-"), n - keep - start)))


def reference_columns(aligned_reference: DataFrame) -> DataFrame:
    """``column`` (of the alignment) of each position of the ungapped reference, from 1."""
    kept = F.filter(F.transform(bases(F.col("seq")), lambda b, i: F.struct((i + 1).alias("column"), b.alias("base"))), lambda x: x["base"] != "-")
    return aligned_reference.select(F.posexplode(kept).alias("ref_pos", "x")).select((F.col("ref_pos") + 1).alias("ref_pos"), F.col("x.column").alias("column"))


def diagnostic_columns(counts: DataFrame, margin: int = 3) -> DataFrame:
    """Columns whose commonest base differs between two groups, each ahead of its second
    base by ``margin`` sequences, from the ``column_counts`` of both groups. Of bases as
    frequent the first by name is the commonest."""
    ranked = F.sort_array(F.array(*[F.struct((-F.col(b)).alias("n"), F.lit(b.upper()).alias("base")) for b in "acgt"]))
    top = counts.where("grp IS NOT NULL").select("pos", "grp", ranked[0]["base"].alias("base"), (-ranked[0]["n"]).alias("n"), (-ranked[1]["n"]).alias("second"))
    top = top.where((F.col("n") > 0) & (F.col("n") - F.col("second") >= margin))
    out = top.groupBy("pos").agg(F.count("*").alias("groups"), F.min("base").alias("low"), F.max("base").alias("high"), F.sort_array(F.collect_list(F.concat_ws(":", "grp", "base"))).alias("calls"))
    return out.where("groups = 2 AND low <> high").select("pos", "calls")
