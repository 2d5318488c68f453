"""Streaming faces of batch operators. Inputs of genotyping are finite files; these serve runs whose reads still arrive."""
