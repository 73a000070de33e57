"""Readers and writers for collections, queries, judgements, runs and vectors."""
