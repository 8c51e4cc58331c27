"""Whole jobs: build and keep a catalogue, search it, extend it."""
