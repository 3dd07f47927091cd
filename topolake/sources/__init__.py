"""Readers of repository trees and small configuration files."""
