"""Schemas of the file formats."""

FASTQ = "id string, desc string, seq string, sep string, qual string, source string, split bigint, pos bigint"
KREPORT = (
    "percents double, total_reads bigint, reads bigint, minimizer_len bigint, minimizer_n_unique bigint, rank string, taxid string, "
    "taxon string, ranks array<string>, taxids array<string>, taxa array<string>, pos bigint, level int, source string"
)
KOUTPUT = "status string, read_id string, taxon string, length string, lca string"
KOUTREADS = "taxid string, tags string, lca string, seq string, qual string"
