"""sparkscope: a PySpark-native search and retrieval engine for source trees and document collections."""
