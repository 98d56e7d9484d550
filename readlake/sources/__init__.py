"""FASTQ, FASTA and archive sources and sinks."""
