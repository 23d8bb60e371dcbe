"""Registry, labelled and study corpora, post tables, and the tables written by jobs."""
