"""newsloom: a DataFrame-native analytics engine for article and document corpora."""
