import os
import sys

# Tests of this folder use each other's plain versions.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
