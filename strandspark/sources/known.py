"""Molecules whose structures are known, in the format of example files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Natural RNAs with their structures and, as a fourth line, pairs that the ensemble is held to.
EXAMPLES = """
tRNA
GCGGAUUUAGCUCAGUUGGGAGAGCGCCAGACUGAAGAUCUGGAGGUCCUGUGUUCGAUCCACAGAAUUCGCACCA
(((((((..((((........)))).(((((.......))))).....(((((.......))))))))))))....

P5abc
CCGUUCAGUACCAAGUCUCAGGGGAAACUUUGAGAUGGCCUUGCAAAGGGUAUGGUAAUAAGCUGACGG
(((.((((.(((..(((((((((....)))))))))..((.......))....)))......)))))))

P4P6_outerjunction
GGAAUUGCGGGAAAGG CUAACCACGCAGCCAAGUCCUAAGUC GAUAUGGAUGCAGUUCA
.....((((((...(( ))..)).))))((...((((...((( )))..))))...))...
...............( )........................( )................

add_riboswitch_aptamer
CGCUUCAUAUAAUCCUAAUGAUAUGGUUUGGGAGUUUCUACCAAGAGCCUUAAACUCUUGAUUAUGAAGUG
(((((((((...((((((.........))))))........((((((.......))))))..)))))))))

P4P6
GGAAUUGCGGGAAAGGGGUCAACAGCCGUUCAGUACCAAGUCUCAGGGGAAACUUUGAGAUGGCCUUGCAAAGGGUAUGGUAAUAAGCUGACGGACAUGGUCCUAACCACGCAGCCAAGUCCUAAGUCAACAGAUCUUCUGUUGAUAUGGAUGCAGUUCA
.....((((((...((((((.....(((.((((.(((..(((((((((....)))))))))..((.......))....)))......)))))))....))))))..)).))))((...((((...(((((((((...)))))))))..))))...))...

5S_rRNA
UGCCUGGCGGCCGUAGCGCGGUGGUCCCACCUGACCCCAUGCCGAACUCAGAAGUGAAACGCCGUAGCGCCGAUGGUAGUGUGGGGUCUCCCCAUGCGAGAGUAGGGAACUGCCAGGCAU
((((((((((.....((((((((....(((((((.............))))..)))...)))))).)).((.......((((((((...)))))))).......))...)))))))))).

cdiGMP_riboswitch_aptamer
GUCACGCACAGGGCAAACCAUUCGAAAGAGUGGGACGCAAAGCCUCCGGCCUAAACCAGAAGACAUGGUAGGUAGCGGGGUUACCGAUGG
..((((......((...((((((....))))))...))...(((.((((((((..((.........)))))))..))))))...)).)).

FN_glycine_riboswitch_aptamer
GGAUAUGAGGAGAGAUUUCAUUUUAAUGAAACACCGAAGAAGUAAAUCUUUCAGGUAAAAAGGACUCAUAUUGGACGAACCUCUGGAGAGCUUAUCUAAGAGAUAACACCGAAGGAGCAAAGCUAAUUUUAGCCUAAACUCUCAGGUAAAAGGACGGAG
.((((((((......((((((....)))))).(((...((((.....))))..)))........))))))))........(((((......(((((.....))))).(((...((((....((((....)))).....))))..))).......)))))

AdoCBL_riboswitch_aptamer
CGGCAGGUGCUCCCGACCCUGCGGUCGGGAGUUAAAAGGGAAGCCGGUGCAAGUCCGGCACGGUCCCGCCACUGUGACGGGGAGUCGCCCCUCGGGAUGUGCCACUGGCCCGAAGGCCGGGAAGGCGGAGGGGCGGCGAGGAUCCGGAGUCAGGAAACCUGCCUGCCG
((((((((((((((((((....))))))))))....(((...(((((.......)))))..(((...))).(((...((((..((((((((((......((((.((((((....))))))...)))))))))))))).....))))....)))....)))))))))))

GIR1_ribozyme
GGUUGGGUUGGGAAGUAUCAUGGCUAAUCACCAUGAUGCAAUCGGGUUGAACACUUAAUUGGGUUAAAACGGUGGGGGACGAUCCCGUAACAUCCGUCCUAACGGCGACAGACUGCACGGCCCUGCCUCUUAGGUGUGUUCAAUGAACAGUCGUUCCGAAAGGAAGCAUCCGGUAUCCCAAGACAAUC
(((((..((((((.(((((((((.......))))))))).((((((((((((((......(((((...((((((((((....))))....)).))))((....)).............))))).((((...))))))))))))).........((((....))))....))))).))))))..)))))

FMN_riboswitch_aptamer
AUCUUCGGGGCAGGGUGAAAUUCCCGACCGGUGGUAUAGUCCACGAAAGUAUUUGCUUUGAUUUGGUGAAAUUCCAAAACCGACAGUAGAGUCUGGAUGAGAGAAGAU
((((((....(.(((.......))))..((((((......))))..((((....))))...(((((.......)))))..)).(((......))).......))))))

HCV_IRES_domainII
CCAUGAAUCACUCCCCUGUGAGGAACUACUGUCUUCACGCAGAAAGCGUCUAGCCAUGGCGUUAGUAUGAGUGUCGUGCAGCCUCCAGGACCCCC
..............((((.((((.....(((((..(((.((...((((((.......))))))....)).)))..).))))))))))))......
"""

#: Sets of examples by name.
SETS = {
    "tRNA": "tRNA",
    "favorites": "tRNA P4P6 add_riboswitch_aptamer 5S_rRNA cdiGMP_riboswitch_aptamer FN_glycine_riboswitch_aptamer AdoCBL_riboswitch_aptamer FMN_riboswitch_aptamer HCV_IRES_domainII",
}


def examples(spark: SparkSession, name: str | None = None) -> DataFrame:
    """(ord, name, sequence, structure, force_base_pairs) of a set in its order, or of all."""
    records = {r[0]: r for r in (block.split("\n") for block in EXAMPLES.strip().split("\n\n"))}
    if name is not None and name not in SETS:
        raise ValueError(f"no set {name!r}; there are {', '.join(SETS)}")
    rows = [(k, *(records[x] + [None])[:4]) for k, x in enumerate(SETS[name].split() if name else records)]
    return spark.createDataFrame(rows, "ord int, name string, sequence string, structure string, force_base_pairs string")


def molecules(spark: SparkSession, name: str | None = None) -> DataFrame:
    """The examples as molecules: mol_id (the name), strands, circle, structure and force."""
    return examples(spark, name).select(F.col("name").alias("mol_id"), F.split("sequence", " ").alias("strands"), F.lit(False).alias("circle"), "structure", F.col("force_base_pairs").alias("force"))
