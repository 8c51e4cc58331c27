"""Readers of corpora, live trees and archives, and shared scratch tables."""
