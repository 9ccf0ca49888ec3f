"""Operators that prepare text corpora for language-model training, each as a Spark job."""
