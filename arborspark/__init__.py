"""Aligned character data, trees and training corpora as Spark DataFrames."""
