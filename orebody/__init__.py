"""Spark-first engine over source trees and technical documents."""
