"""Row-local Column functions: ranges, sequences, CIGAR, statistics."""
