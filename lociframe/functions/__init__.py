"""Column functions: statistics, alleles, genotypes, text."""
