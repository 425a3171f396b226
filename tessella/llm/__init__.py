"""Corpus-preparation operators: cleaning, de-duplication, scoring, sharding and tokenisation of documents."""
