import pytest

pytest.importorskip("chronolens.llm.catalog")
